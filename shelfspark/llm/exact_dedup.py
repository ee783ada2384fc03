"""Exact de-duplication through a persistent digest index.

The index is a folder that outlives the session: a table (digest, keep_id, group_size, batch) with a row for
each digest, as of the batch that brought it in, and a table of changes in the same form, with a row for each
later batch that holds the digest again. Both are bucketed and sorted by digest; their number of buckets is
kept in the folder. New documents are digested, one row per digest goes on, the digests that the index
lacks are found by a sort-merge anti-join on the bucketed side (the index is not shuffled) and appended, those
that it has become changes. The state of a digest is the largest keep_id and the sum of the sizes.

A batch has a name; a batch that is run again after a failure appends what is missing of it and no more.

Cases: null text counts as empty; empty texts are equal to each other; of equal texts the largest
doc_id stays, of all batches so far (rows without a doc_id lose against any other, and have a null keep_id if
there is no other); a repeated row counts each time in group_size, and each row of the kept doc_id is kept; an
empty table gives no rows; other columns are not read."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.vec import batch_of, bounded_batches, column
from shelfspark.session import checkpoint_dir, cut_lineage
from shelfspark.sources.readers import read_if_any

_DIGESTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])


def _digest(batches):
    for b in batches:
        texts = column(b, "text").to_pylist()
        # bytes.lower() changes A-Z alone
        yield batch_of(_DIGESTS, column(b, "doc_id"),
                       [hashlib.sha256((t or "").encode().lower()).digest() for t in texts])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digest, "doc_id long, digest binary")


class DigestIndex:
    """Digest index in ``path``; the same path opens the same index in a later session. ``buckets`` is for a new index (64);
    an index that exists has its own, and another number is refused."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        held = read_if_any(spark, f"{self.path}/buckets")
        self.buckets = held.first().buckets if held is not None else buckets or 64
        if buckets is not None and buckets != self.buckets:
            raise ValueError(f"the index in {path} has {self.buckets} buckets, not {buckets}")
        if held is None:
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.parquet(f"{self.path}/buckets")
        name = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:20]
        self.table, self.change_table = name, f"{name}_changes"
        for table, folder in ((self.table, "digests"), (self.change_table, "changes")):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
                      f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'")

    def read(self) -> DataFrame:
        """The digests, as of the batches that brought them in."""
        return self.spark.table(self.table)

    def changes(self) -> DataFrame:
        return self.spark.table(self.change_table)

    def close(self) -> None:
        """Takes the tables out of the catalogue; the folder stays and may be opened again."""
        for table in (self.table, self.change_table):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def append(self, batch: DataFrame, name: str) -> None:
        """Adds the documents of ``batch`` (doc_id, digest), a batch of that name, to the index.

        One row a digest meets the index: the groups are cut off, else the optimizer would move the joins below the
        aggregation, where a digest that very many documents hold comes whole to one task."""
        groups = cut_lineage(batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                             .withColumn("batch", F.lit(name)))
        for table, rows in ((self.table, self.missing(groups, name)), (self.change_table, self.known(groups, name))):
            if self.spark.table(table).filter(F.col("batch") == name).isEmpty():
                (rows.repartition(self.buckets, "digest").write.mode("append").format("parquet")
                 .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table))

    def _before(self, name: str | None) -> DataFrame:
        index = self.read() if name is None else self.read().filter(F.col("batch") != name)
        return index.select("digest").hint("merge")

    def missing(self, groups: DataFrame, name: str | None = None) -> DataFrame:
        """Rows whose digest the index lacks: a sort-merge anti-join with the bucketed side, which is not shuffled. What the
        batch ``name`` has brought in itself does not count."""
        return groups.hint("merge").join(self._before(name), "digest", "left_anti")

    def known(self, groups: DataFrame, name: str | None = None) -> DataFrame:
        """Rows whose digest the index has."""
        return groups.hint("merge").join(self._before(name), "digest", "left_semi")

    def lookup(self, groups: DataFrame) -> DataFrame:
        """(digest, keep_id, group_size): the index's rows of the digests in ``groups``, without later changes."""
        return groups.select("digest").hint("merge").join(self.read().drop("batch").hint("merge"), "digest")

    def state(self) -> DataFrame:
        """(digest, keep_id, group_size) of every digest, as of the last batch. Neither table is shuffled."""
        later = self.changes().groupBy("digest").agg(F.max("keep_id").alias("later_id"), F.sum("group_size").alias("more"))
        return (self.read().hint("merge").join(later.hint("merge"), "digest", "left")
                .select("digest", F.greatest("keep_id", "later_id").alias("keep_id"), (F.col("group_size") + F.coalesce("more", F.lit(0))).alias("group_size")))


def exact_dedup(docs: DataFrame, index: DigestIndex, batches: int = 1) -> DataFrame:
    """Appends ``docs`` to the index, in so many batches by hash of doc_id, and returns each of its documents with the one that
    stays, of these and all that the index has seen before."""
    name, part = uuid.uuid4().hex, F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    seen = cut_lineage(digests(docs))
    for i in range(batches):
        index.append(seen.filter(part == i), f"{name}_{i}")
    # cut off, so that both sides of the last join have plain exchanges, which AQE splits where one digest holds very many documents
    state = cut_lineage(seen.select("digest").distinct().hint("merge").join(index.state().hint("merge"), "digest"))
    return (seen.join(state, "digest")
            .select("doc_id", "keep_id", "group_size",
                    F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = DigestIndex(spark, f"{checkpoint_dir(spark).rstrip('/')}/digest_index_{uuid.uuid4().hex}", buckets)
    found = exact_dedup(docs, index, batches=3)      # two of the batches meet an index that is not empty
    index.close()                                    # nothing of the result reads its tables any more
    return found


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT sha256(t) AS h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, g.h AS text_sha256
FROM d JOIN g ON sha256(d.t) = g.h
"""
