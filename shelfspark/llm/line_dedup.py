"""Line de-duplication with two Bloom filters.

Pass 1 hashes each line's key and deals 64-bit hashes to the filter's segments: the first filter holds
hashes seen once, the second those seen again. Pass 2 scans again with the second filter: only keys
that it may hold (suspects) are shuffled, as (128-bit digest, doc_id), for exact counting and for the
choice of the document that keeps the line. Last, the dropped keys meet their documents by doc_id.

Cases: null or empty text is one empty line; keys shorter than ``min_chars`` are never dropped; a key
counts once per document however often it stands there; rows without a doc_id take no part and stay
whole; rows that repeat a doc_id are one document for counting, each keeps its own lines; an empty
table gives no rows; other columns (of ``dedup_lines``) stay as they are."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.bloom import FILTER_LOG2, twice_filter
from shelfspark.llm.vec import batch_of, bounded_batches, column
from shelfspark.session import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
_HASHES = pa.schema([("h", pa.int64())])
_SUSPECTS = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])


def _keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """Key of each line, None for one that is too short to count. bytes.lower() changes A-Z alone."""
    out = []
    for line in (text or "").split("\n"):
        line = line.strip(WHITE)
        out.append(line.encode().lower() if len(line) >= min_chars else None)
    return out


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def repeated_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, log2: int = FILTER_LOG2) -> DataFrame:
    """(doc_id, keys): digests of the line keys that the document loses."""
    bounded_batches(docs.sparkSession)
    docs = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def hashes(batches):
        for b in batches:
            ids = column(b, "doc_id").to_pylist()
            each = {}                                    # a hash goes on twice at most from a batch, however many documents hold it
            for i, t in zip(ids, column(b, "text").to_pylist(), strict=True):
                for k in {k for k in _keys(t, min_chars) if k}:
                    h = xxhash.xxh3_64_intdigest(k)
                    held = each.setdefault(h, [i])
                    if held[-1] != i and len(held) < 2:
                        held.append(i)
            yield batch_of(_HASHES, np.repeat(np.fromiter(each, np.uint64, len(each)), [len(x) for x in each.values()]).view(np.int64))

    twice = docs.sparkSession.sparkContext.broadcast(twice_filter(docs.mapInArrow(hashes, "h long"), log2))

    def suspects(batches):
        for b in batches:
            ids, out = [], []
            for i, t in zip(column(b, "doc_id").to_pylist(), column(b, "text").to_pylist(), strict=True):
                keys = list({k for k in _keys(t, min_chars) if k})
                h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
                found = [_digest(keys[j]) for j in np.flatnonzero(twice.value.holds(h))]
                ids += [i] * len(found)
                out += found
            yield batch_of(_SUSPECTS, ids, out)

    found = cut_lineage(docs.mapInArrow(suspects, "doc_id long, key binary"))
    # a third of all documents may hold one key: partial counts before the shuffle; the counts are cut off so that
    # the join below has plain exchanges on both sides, which AQE splits where a key is hot
    counts = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    if min_docs > 1:                                     # repeated rows of one doc_id are one document
        counts = (found.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key")
                  .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")))
    counts = cut_lineage(counts.filter(F.col("n") >= min_docs).select("key", "last"))
    lost = found.join(counts, "key").filter(F.col("doc_id") < F.col("last"))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _strip(text: str | None, lost: list[bytes] | None, min_chars: int) -> tuple[str, int, int]:
    """The text without the lines whose key's digest is in ``lost``, its lines before, and those dropped."""
    lines = (text or "").split("\n")
    if not lost:
        return text or "", len(lines), 0
    gone = set(lost)
    stay = [x for x, k in zip(lines, _keys(text, min_chars), strict=True) if k is None or _digest(k) not in gone]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, log2: int = FILTER_LOG2) -> DataFrame:
    """``docs`` with the repeated lines out of ``text``, and n_lines, n_dropped beside (in place of columns so named)."""
    lost = repeated_keys(docs, min_chars, min_docs, log2).select(F.col("doc_id").alias("id"), F.col("keys"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])     # no name can clash
    id_, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    met = plain.join(lost, F.col(id_).cast("long") == F.col("id"), "left").drop("id")
    schema = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in names],
                         F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema

    def strip(batches):
        for b in batches:
            done = [_strip(t, k, min_chars) for t, k in zip(column(b, text).to_pylist(), column(b, "keys").to_pylist(), strict=True)]
            left, n, dropped = (pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64())))
            cols = [left if f"c{i}" == text else column(b, f"c{i}") for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, n, dropped], names=[*names, "n_lines", "n_dropped"])

    return met.mapInArrow(strip, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, coalesce(k.doc_id < r.last, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
