"""Keys and windows: keep-last / keep-first per key, latest row per entity, key upsert,
and projection onto the columns that exist (E1-E3, F1, F2, A8, B1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _orders(order: Sequence, descending: bool):
    out = []
    for o in order:
        c = F.col(o) if isinstance(o, str) else o
        out.append(c.desc_nulls_last() if descending else c.asc_nulls_last())
    return out


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key, the one with the largest ``order``.

    ``row_number() == 1`` is planned by Spark as a WindowGroupLimit that runs before the shuffle
    too, so a hot key ships one candidate row per map task instead of all of its rows."""
    w = Window.partitionBy(*keys).orderBy(*_orders(order, True))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key, the one with the smallest ``order``."""
    w = Window.partitionBy(*keys).orderBy(*_orders(order, False))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest(df: DataFrame, key: str = "entity_id", order: str = "date", mode: str = "last_non_null") -> DataFrame:
    """Latest state per entity.

    ``last_non_null`` (default) reproduces pandas ``sort_values(order).groupby(key).last()``: each
    column independently takes its last non-null value. It is one hash aggregate with
    ``max_by(c, CASE WHEN c IS NOT NULL THEN order END)`` per column; ``max_by`` is partially
    aggregated map-side, so a hot entity does not land whole in one task.
    ``last_row`` takes the whole last row (ties impossible: (key, order) is unique)."""
    if mode == "last_row":
        return keep_last(df, [key], [order])
    o = F.col(order)
    aggs = [F.max(o).alias(order)]
    for c in df.columns:
        if c in (key, order):
            continue
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c))
    return df.groupBy(key).agg(*aggs).select(*df.columns)


def project_available(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B1: the listed columns that exist, in the listed order; NaN turned to NULL."""
    dtypes = dict(df.dtypes)
    out = []
    for c in cols:
        if c not in dtypes:
            continue
        if dtypes[c] in ("double", "float"):
            out.append(F.nanvl(F.col(c), F.lit(None).cast(dtypes[c])).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def append_by_name(existing: DataFrame, new: DataFrame) -> DataFrame:
    """union by column name; the new rows are cut down to the existing columns."""
    common = [c for c in existing.columns if c in new.columns]
    return existing.unionByName(new.select(*common), allowMissingColumns=True)


def upsert(existing: DataFrame | None, new: DataFrame, keys: Sequence[str],
           order: Sequence | None = None) -> DataFrame:
    """Union new rows into a keyed table and keep the **last** row per key.

    "Last" is the new side over the existing side, then ``order`` within a side. The result is
    what the sink writes with dynamic partition overwrite (see ``sources.writers``)."""
    tagged_new = new.withColumn("_side", F.lit(1))
    if existing is None:
        both = tagged_new
    else:
        both = append_by_name(existing.withColumn("_side", F.lit(0)), tagged_new)
    ordering = [F.col("_side")] + [F.col(o) if isinstance(o, str) else o for o in (order or [])]
    return keep_last(both, keys, ordering).drop("_side")
