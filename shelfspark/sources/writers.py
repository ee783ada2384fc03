"""Sinks (A7-A10): typed record files, keyed serving tables, catalogue outputs.

All writes go through Spark's commit protocol (a failed or retried task never leaves partial
output), keyed tables use dynamic partition overwrite on ``date`` so a replayed day replaces only
its own partition, and outputs are coalesced per partition to avoid the small-file problem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import catalog
from ..operators.keys import upsert
from ..session import cut_lineage
from .readers import read_if_any


def salted(df: DataFrame, partition_col: str, buckets: int | None = None) -> DataFrame:
    """Cluster rows by output partition, but spread each output partition over ``buckets`` tasks
    with a deterministic salt (hash of the row), so one large date / content type is written by
    many tasks, not one, and a retried task produces the same split. ``buckets`` defaults to
    ``spark.sql.shuffle.partitions / 8`` (1 locally: one file per partition value)."""
    if buckets is None:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        buckets = max(1, n // 8)
    if buckets == 1:
        return df.repartition(partition_col)
    hashable = [c for c, t in df.dtypes if not t.startswith("map")]      # maps cannot be hashed
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in hashable]), F.lit(buckets))
    return df.repartition(F.col(partition_col), salt)


#: The outputs of the scrape, each counted by its write.
OUTPUTS = ("products", "reviews", "ads", "trends", "unclassified")


class Counted:
    """``df`` with counts that its own write makes (``observe``): no second pass over the data. The counts are taken in the
    job's last stage, where each partition is counted once even if an executor was lost and shuffle output made anew."""

    def __init__(self, df: DataFrame, **counts: Column):
        self._seen, self._names = Observation(), list(counts)
        self.df = df.observe(self._seen, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in counts.items()])

    def counts(self) -> dict[str, int]:
        """After the write; waits for it otherwise. A write that Spark found to be of no rows has zeros."""
        got = self._seen.get
        return {n: got.get(n, 0) for n in self._names}


def write_by_type(records: DataFrame, out_dir: str, mode: str = "append") -> dict[str, int]:
    """One job writes every content type: ``records`` is (output, value JSON); files land in
    ``out_dir/output=<products|reviews|ads|trends|unclassified>/``. Returns the records written: in all (``records``), for each
    output, for outputs of other names (``other``), and those without a value among them (``blank``: empty lines)."""
    output = F.coalesce("output", F.lit(""))
    out = Counted(salted(records, "output"), records=F.count(F.lit(1)), **{n: F.count_if(output == n) for n in OUTPUTS},
                  other=F.count_if(~output.isin(*OUTPUTS)), blank=F.count_if(F.col("value").isNull()))
    out.df.write.mode(mode).partitionBy("output").text(out_dir)
    return out.counts()


def write_keyed(df: DataFrame, path: str, partition_col: str = "date") -> None:
    """A8 sink: dynamic partition overwrite -- only the partitions present in ``df`` are replaced,
    atomically per partition through the commit protocol."""
    (salted(df, partition_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(path))


def upsert_table(spark, path: str, new: DataFrame, keys, partition_col: str = "date", order=None) -> None:
    """Read the affected partitions of the existing table, keep the last row per key, and
    overwrite just those partitions. The existing side is pruned to the new rows' partitions by a
    semi join on the partition column (dynamic partition pruning at the scan)."""
    existing = read_if_any(spark, path)
    if existing is None:
        write_keyed(new, path, partition_col)
        return
    touched = new.select(partition_col).distinct()
    old = existing.join(touched, partition_col, "left_semi")
    merged = upsert(old, new, keys, order)
    # materialise before overwriting the partitions we read from
    write_keyed(cut_lineage(merged), path, partition_col)


def write_catalog(deduped: DataFrame, skus: DataFrame, out_dir: str) -> dict[str, int]:
    """Deduplicated records, the SKU registry (one line per SKU; ``total_skus`` is the line
    count), the nested taxonomy (one JSON document per category) and the flat leaves. Returns what the writes counted (D11):
    ``input``, ``output`` and ``duplicates_removed`` of the dedup, ``unique_skus``, ``categories`` and ``leaves``."""
    tables = {
        "deduped_products": Counted(deduped.drop("seq"), input=F.sum("merged_count"), output=F.count(F.lit(1))),
        "sku_registry": Counted(skus.drop("seq"), unique_skus=F.count(F.lit(1))),
        "hierarchy": Counted(catalog.taxonomy_tree(skus), categories=F.count(F.lit(1))),
        "hierarchy_flat": Counted(catalog.taxonomy_flat(skus), leaves=F.count(F.lit(1)))}
    stats: dict[str, int] = {}
    for name, table in tables.items():
        table.df.write.mode("overwrite").json(f"{out_dir}/{name}")
        stats |= table.counts()
    return stats | {"duplicates_removed": stats["input"] - stats["output"]}


def fva_serving(fva: DataFrame) -> DataFrame:
    """A10: forecast-vs-actual extract ordered by (date, entity)."""
    return fva.orderBy("date", "entity_id")


def write_fva_serving(fva: DataFrame, path: str) -> None:
    # range-partitioned global sort: output files are in (date, entity) order
    fva_serving(fva).write.mode("overwrite").parquet(path)
