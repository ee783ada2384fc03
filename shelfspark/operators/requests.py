"""The requests of a crawl as a table that only grows.

A level of the crawl is one partition, bucketed and sorted by URL, and written once: what a level costs in bytes
follows its own requests, not those before it. The fetched pages' links are kept beside it in the same buckets, so
that neither the requests already seen nor the links are shuffled again at any level. Requests counted by domain are
kept a level at a time too. A level counts once its entry in ``done`` is written; a crawl that was stopped before
that does the level again, over what is there of it."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import read_if_any

COLUMNS = {"url": "string", "seed_category": "string", "seed_domain": "string", "origin_url": "string", "depth": "int", "max_depth": "int",
           "parent_url": "string", "product_hint": "string", "page_type": "string"}


class Requests:
    """The crawl in folder ``path`` (any URI); ``buckets`` is for a new one, one that exists has its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        held = read_if_any(spark, f"{self.path}/buckets")
        self.buckets = held.first().buckets if held is not None else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if buckets is not None and buckets != self.buckets:
            raise ValueError(f"the crawl in {path} has {self.buckets} buckets, not {buckets}")
        if held is None:
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.parquet(f"{self.path}/buckets")
        name = hashlib.sha256(self.path.encode()).hexdigest()[:20]
        self.table, self.links_table = f"requests_{name}", f"request_links_{name}"
        self._create(self.table, COLUMNS, "requests")
        self._create(self.links_table, {"url": "string", "links": "array<string>", "html_type": "string"}, "links", "part")

    def _create(self, table: str, columns: dict[str, str], folder: str, by: str = "level") -> None:
        """Only the partitions that are written are overwritten, so a level may read those before it."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(f'{c} {t}' for c, t in columns.items())}, {by} INT) USING parquet "
                       f"OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY ({by}) "
                       f"CLUSTERED BY (url) SORTED BY (url) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'")
        if read_if_any(self.spark, f"{self.path}/{folder}") is not None:
            self.spark.sql(f"MSCK REPAIR TABLE {table}")                # partitions that another session wrote

    def _write(self, table: str, rows: DataFrame, partition: int) -> None:
        rows.repartition(self.buckets, "url").withColumn("_part", F.lit(partition)).write.insertInto(table, overwrite=True)

    def done(self) -> tuple[int, int] | None:
        """The last finished level and how many requests it has; None before the first."""
        held = read_if_any(self.spark, f"{self.path}/done")
        last = held.agg(F.max(F.struct("level", "n")).alias("last")).first().last if held is not None else None
        return (last.level, last.n) if last is not None else None

    def read(self) -> DataFrame:
        """All requests of the finished levels."""
        last = self.done()
        return self.spark.table(self.table).filter(F.col("level") <= (last[0] if last else -1))

    def enqueued(self) -> DataFrame:
        """(seed_domain, enqueued) over all finished levels, from the counts that each level left."""
        counts = read_if_any(self.spark, f"{self.path}/counts")
        last = self.done()
        if counts is None or last is None:
            return self.spark.createDataFrame([], "seed_domain string, enqueued bigint")
        return counts.filter(F.col("level") <= last[0]).groupBy("seed_domain").agg(F.sum("enqueued").alias("enqueued"))

    def keep_links(self, pages_links: DataFrame) -> None:
        """Extracts the pages' links once; a crawl that goes on has them already."""
        if read_if_any(self.spark, f"{self.path}/kept") is None:
            self._write(self.links_table, pages_links.filter(F.col("url").isNotNull()).select("url", "links", "html_type"), 0)
            self.spark.range(1).coalesce(1).write.parquet(f"{self.path}/kept")

    def links(self) -> DataFrame:
        return self.spark.table(self.links_table).drop("part")

    def write_level(self, level: int, rows: DataFrame) -> int:
        """Writes a level and its counts, then its entry; returns its number of requests."""
        self._write(self.table, rows.select(*[F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()]), level)
        written = self.spark.table(self.table).filter(F.col("level") == level)
        counts = f"{self.path}/counts/level={level}"
        written.groupBy("seed_domain").agg(F.count(F.lit(1)).alias("enqueued")).write.mode("overwrite").parquet(counts)
        n = self.spark.read.parquet(counts).agg(F.coalesce(F.sum("enqueued"), F.lit(0)).alias("n")).first().n
        self.spark.createDataFrame([(n,)], "n bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/level={level}")
        return n

    def close(self) -> None:
        """Takes the tables out of the catalogue; the folder stays."""
        for table in (self.table, self.links_table):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
