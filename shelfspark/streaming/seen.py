"""K4 / C3 without forgetting: URLs that a stream has ever brought are never new again.

The watermark form (``feed.seen_url_dedup``) lets a URL in again after its delay. Here the URLs seen are a table
in a folder, (url, ts, batch), appended to and never rewritten, bucketed and sorted by URL. A micro-batch keeps
one row a URL (the first by time) and meets the table in a sort-merge anti-join, bucket by bucket: only the batch
is shuffled. What it appends is what the stream emits. A batch that Spark runs again finds its own rows there and
appends nothing."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.readers import read_if_any


class SeenUrls:
    """The table in ``path`` (any URI); ``buckets`` is for a new table, one that exists has its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        held = read_if_any(spark, f"{self.path}/buckets")
        self.buckets = held.first().buckets if held is not None else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if buckets is not None and buckets != self.buckets:
            raise ValueError(f"the table in {path} has {self.buckets} buckets, not {buckets}")
        if held is None:
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.parquet(f"{self.path}/buckets")
        self.table = "seen_urls_" + hashlib.sha256(self.path.encode()).hexdigest()[:20]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (url STRING, ts TIMESTAMP, batch STRING) USING parquet "
                  f"CLUSTERED BY (url) SORTED BY (url) INTO {self.buckets} BUCKETS LOCATION '{self.path}/urls'")

    def read(self) -> DataFrame:
        """(url, ts, batch): every URL with its first sighting. Micro-batches append in a session of their own, so the list of
        files is read anew."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def close(self) -> None:
        """Takes the table out of the catalogue; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def unseen(self, urls: DataFrame, batch: str = "") -> DataFrame:
        """Rows of ``urls`` (url, ...) that no other batch has brought. The table's side is not shuffled."""
        return urls.hint("merge").join(self.read().filter(F.col("batch") != batch).select("url").hint("merge"), "url", "left_anti")

    def add(self, urls: DataFrame, batch: str) -> None:
        """Appends the URLs of a batch of this name (url, ts) that are new; null URLs are none."""
        if not self.read().filter(F.col("batch") == batch).isEmpty():
            return
        first = urls.filter(F.col("url").isNotNull()).groupBy("url").agg(F.min("ts").alias("ts"))       # a hot URL is one row a task
        (self.unseen(first, batch).select("url", "ts", F.lit(batch).alias("batch")).repartition(self.buckets, "url")
         .write.mode("append").format("parquet").bucketBy(self.buckets, "url").sortBy("url").saveAsTable(self.table))


def run_seen_urls(stream: DataFrame, seen: SeenUrls, checkpoint: str | None = None) -> DataFrame:
    """Drives a stream of (url, ts) to its present end and returns the URLs that it was the first to bring."""
    spark = seen.spark
    ck = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/seen-{uuid.uuid4().hex}"
    before = {r.batch for r in seen.read().select("batch").distinct().collect()}                        # a name a batch

    def tick(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        seen.add(batch.select("url", "ts"), f"{run}-{batch_id}")

    stream.writeStream.foreachBatch(tick).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return seen.read().filter(~F.col("batch").isin(list(before))) if before else seen.read()
