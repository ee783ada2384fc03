"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage


ROWS_A_TASK = 50_000


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_TASK))


def compact(df: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """``df`` checkpointed and read in as few tasks as its rows need, and its number of rows: a small table that goes
    through many exchanges would else write a file for each of its many empty partitions every time. Where no more than
    ``most`` rows can come out, the checkpoint itself is written in as few."""
    df = cut_lineage(df if most is None else df.coalesce(tasks_for(most)))
    n = df.count()
    return df.coalesce(tasks_for(n)), n


def _least(edges: DataFrame, own: bool) -> DataFrame:
    """Least neighbour of each u (u itself too, if ``own``)."""
    m = edges.groupBy("u").agg(F.min("v").alias("m"))
    return m.withColumn("m", F.least("u", "m")) if own else m


def _starred(edges: DataFrame) -> bool:
    """Whether each node but the roots has one edge, to a root."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in ``edges`` (u, v): root is the least id of its component.

    A round is two aggregations and two equi-joins of the edge table, until every component is a star; a node with
    very many neighbours is reduced to its least neighbour by partial aggregation, and its edges are dealt anew in
    the join, where the other side has one row a node."""
    edges, n = compact(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _starred(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest, _ = compact(_least(both, own=True), 2 * n)
        large, n = compact(both.join(nearest, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), 2 * n)
        least = _least(large, own=False)
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        edges, n = compact(small, 2 * n)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
