"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def dense_rank_desc(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """``df`` with column ``name``: the dense rank of ``value`` (largest first, nulls last) among the rows of its ``groups``.

    No task holds a whole group. The distinct values (combined map-side) are cut by range over (groups, value), so a hot
    group lies in many neighbouring ranges; a value's rank is its place among its group's values in its range, plus the number
    of the group's values in earlier ranges (at most one count a group and range). Rows then get their value's rank in an
    equi-join on groups and value, whose skewed partitions AQE splits. The ranges come from a sample, so the cut table is
    checkpointed before it is read twice. Null groups are groups; the columns' names must not start with ``_rank``."""
    keys = [*groups, value]
    order = [*[F.col(c) for c in groups], F.col(value).desc_nulls_last()]
    cut = cut_lineage(df.select(*keys).distinct().repartitionByRange(*order).withColumn("_rank_range", F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy("_rank_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (cut.groupBy(*groups, "_rank_range").agg(F.count(F.lit(1)).alias("_rank_n"))
               .select(*[F.col(c).alias(f"_rank_{i}") for i, c in enumerate(groups)], F.col("_rank_range").alias("_rank_at"),
                       F.coalesce(F.sum("_rank_n").over(before), F.lit(0)).alias("_rank_before")))
    inside = cut.withColumn("_rank_in", F.row_number().over(Window.partitionBy("_rank_range", *groups).orderBy(F.col(value).desc_nulls_last())))
    same = F.col("_rank_range") == F.col("_rank_at")
    for i, c in enumerate(groups):
        same = same & F.col(c).eqNullSafe(F.col(f"_rank_{i}"))
    ranks = inside.join(earlier, same).select(*[F.col(c).alias(f"_rank_key{i}") for i, c in enumerate(keys)],
                                              (F.col("_rank_in") + F.col("_rank_before")).cast("bigint").alias(name))
    own = F.lit(True)
    for i, c in enumerate(keys):
        own = own & F.col(c).eqNullSafe(F.col(f"_rank_key{i}"))
    return df.join(ranks, own, "left").select(*df.columns, name)
