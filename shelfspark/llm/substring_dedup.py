"""Substring de-duplication: seed on winnowed anchors, extend to whole windows, keep maximal repeats.

* Copies. Of documents with the same text only the one with the least doc_id goes through the search; in
  the others every window is a repeat. A filter of the doc_ids that do go through tells them apart: what
  it lets through wrongly is searched like any other.
* Seed. Of the nine 5-word runs of each 13-word window the one with the least hash is the window's
  anchor, so equal windows have equal anchors. Documents meet on anchors: each sends its distinct anchor
  hashes once, and a pair of Bloom filters of a fixed size keeps those that a second document brings (a
  filter too small for its input lets more through, and loses nothing).
* Extend. Around each anchor that the filter holds, every 13-word window that has it as its anchor is
  hashed (96 bits), which extends the seed both ways in all its alignments at once. No pair of
  documents is made: occurrences are sorted by (window, doc_id) and one pass over each partition tells
  which have a smaller doc_id before them. A window that lies in several documents of one slice is
  settled there but for the smallest, so a passage that a third of all documents share sends one row
  per slice.
* Keep. Settled windows of a document run together into maximal repeats of at least 13 words, whose
  words are removed.

Cases: null text has no words; a document of under 13 words loses nothing; repeats inside one document
stay; rows that share a doc_id do not remove each other's words; rows without a doc_id stay whole and
take no part; an empty table gives no rows; other columns (of ``remove_repeats``) stay as they are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import vec
from shelfspark.llm.bloom import FILTER_LOG2, seen_filter, twice_filter
from shelfspark.llm.vec import batch_of, column

U = np.uint64
WINDOW, ANCHOR = 13, 5
_ANCHORS = pa.schema([("h", pa.int64())])
_WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int32()), ("doc_id", pa.int64()), ("run", pa.int64())])
_RUNS = pa.schema([("doc_id", pa.int64()), ("run", pa.int64())])
# A run of windows in one number: 7 bits that tell rows of one doc_id apart, the number of windows (0: one,
# not settled yet), the first window's word number.
TAG, SPAN = 56, 36
MOST = (1 << TAG - SPAN) - 1


def _tags(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """7 bits of each row's words."""
    edge = np.searchsorted(row, np.arange(rows + 1))
    total = np.concatenate([np.zeros(1, U), np.cumsum(h)])
    return (vec.mix(total[edge[1:]] - total[edge[:-1]]) >> U(57)).astype(np.int64)


def _joined(doc: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted windows of each document as runs without a gap."""
    if not len(doc):
        return doc, run
    start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (run[1:] != run[:-1] + 1)])
    span = np.diff(np.r_[start, len(doc)])
    pieces = -(-span // MOST)                                     # a run that is too long for its bits goes in pieces
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(np.repeat(span, pieces) - nth * MOST, MOST)
    return np.repeat(doc[start], pieces), np.repeat(run[start], pieces) + nth * MOST + (size << SPAN)


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, log2: int = FILTER_LOG2) -> DataFrame:
    """(doc_id, run): runs of windows that also start in a document with a smaller doc_id."""
    vec.bounded_batches(docs.sparkSession)
    docs = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sc = docs.sparkSession.sparkContext
    firsts = docs.groupBy(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")).agg(F.min("doc_id").alias("first"))
    searched = sc.broadcast(seen_filter(firsts.select(F.xxhash64("first")), log2))
    docs = docs.withColumn("h", F.xxhash64("doc_id"))

    def windows(b):
        """Per slice: doc_ids, row and hash of each word, start and anchor of each window."""
        for lo, hi, buf, offs in vec.slices(column(b, "text")):
            ids = column(b, "doc_id").to_numpy(zero_copy_only=False)[lo:hi].astype(np.int64)
            _, _, row, h = vec.words(buf, offs)
            if len(h) >= window:
                at = np.flatnonzero(row[: len(h) - window + 1] == row[window - 1:])
                yield ids, row, h, at, vec.rolling_min(vec.grams(h, anchor), window - anchor + 1)[at]

    def parted(b):
        """Rows to search, and copies."""
        first = searched.value.holds(column(b, "h").to_numpy(zero_copy_only=False).view(U))
        return b.filter(pa.array(first)), b.filter(pa.array(~first))

    def anchors(batches):
        for b in batches:
            for ids, row, _, at, pick in windows(parted(b)[0]):
                doc = ids[row[at]]
                order = np.lexsort((doc, pick))
                h, d = pick[order], doc[order]
                new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
                other = np.r_[False, (h[1:] == h[:-1]) & (d[1:] != d[:-1])] if len(h) else new
                group = np.cumsum(new) - 1
                second = np.unique(group[other])                  # held by two documents here: sent twice, however many hold it
                first = h[new]
                yield batch_of(_ANCHORS, vec.signed(np.concatenate([first, first[second]])))

    seeds = sc.broadcast(twice_filter(docs.mapInArrow(anchors, "h long"), log2))

    def extend(batches):
        for b in batches:
            search, copies = parted(b)
            for ids, row, h, at, _ in windows(copies):
                doc, run = _joined(ids[row[at]], (_tags(h, row, len(ids))[row[at]] << TAG) | (at - np.searchsorted(row, np.arange(len(ids)))[row[at]]))
                yield batch_of(_WINDOWS, vec.signed(vec.mix(run.view(U))), np.zeros(len(doc), np.int32), doc, run)
            for ids, row, h, at, pick in windows(search):
                at = at[seeds.value.holds(pick)]
                w1 = vec.signed(vec.grams(h, window)[at])
                w2 = (vec.grams(h, window, vec.BASE2)[at] >> U(32)).astype(np.uint32).view(np.int32)
                r = row[at]
                doc = ids[r]
                run = (_tags(h, row, len(ids))[r] << TAG) | (at - np.searchsorted(row, np.arange(len(ids)))[r])
                order = np.lexsort((doc, w2, w1))
                a, c, d = w1[order], w2[order], doc[order]
                group = np.cumsum(np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]) - 1 if len(a) else np.zeros(0, int)
                settled = np.zeros(len(at), bool)
                settled[order] = d > d[np.searchsorted(group, group)]
                yield batch_of(_WINDOWS, w1[~settled], w2[~settled], doc[~settled], run[~settled])
                doc, run = _joined(doc[settled], run[settled])
                yield batch_of(_WINDOWS, vec.signed(vec.mix(run.view(U))), np.zeros(len(doc), np.int32), doc, run)

    def compare(batches):
        """Rows sorted by window and doc_id; what the last row was is carried from batch to batch."""
        last, least = None, None
        for b in batches:
            w1, w2, doc, run = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            settled = (run >> SPAN) & MOST > 0
            yield batch_of(_RUNS, doc[settled], run[settled])
            w1, w2, doc, run = w1[~settled], w2[~settled], doc[~settled], run[~settled]
            if not len(w1):
                continue
            new = np.r_[last != (w1[0], w2[0]), (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]
            group = np.cumsum(new)                                # 0: goes on from the batch before
            firsts = np.r_[doc[0] if least is None else least, doc[new]]
            found = doc > firsts[group]
            yield batch_of(_RUNS, doc[found], run[found] + (1 << SPAN))
            last, least = (w1[-1], w2[-1]), firsts[group[-1]]

    return (docs.mapInArrow(extend, "w1 long, w2 int, doc_id long, run long")
            .repartition(F.col("w1")).sortWithinPartitions("w1", "w2", "doc_id")
            .mapInArrow(compare, "doc_id long, run long"))


def _kept_words(text: str | None, runs: list[int] | None, window: int) -> tuple[list[bytes], int]:
    """Words that stay, and the number of all words."""
    raw = (text or "").encode()
    words = raw.split()                                            # bytes split at \x20 and \x09-\x0D alone
    if not runs:
        return words, len(words)
    _, _, row, h = vec.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    run = np.array(runs, np.int64)
    run = run[run >> TAG == _tags(h, row, 1)[0]]
    pos, span = run & ((1 << SPAN) - 1), (run >> SPAN) & MOST
    cover = np.zeros(len(words) + 1, np.int64)
    fits = pos + span + window - 1 <= len(words)                   # always, but for a row whose tag another row of its doc_id shares
    np.add.at(cover, pos[fits], 1)
    np.add.at(cover, (pos + span + window - 1)[fits], -1)
    gone = (np.cumsum(cover[:-1]) > 0).tolist()
    return [w for w, g in zip(words, gone, strict=True) if not g], len(words)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, log2: int = FILTER_LOG2) -> DataFrame:
    """``docs`` with repeated words out of ``text`` (the rest joined by one space), and n_words, n_removed beside."""
    found = repeats(docs, window, anchor, log2).groupBy("doc_id").agg(F.collect_list("run").alias("runs"))
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    id_, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    met = plain.join(found.withColumnRenamed("doc_id", "id"), F.col(id_).cast("long") == F.col("id"), "left").drop("id")
    schema = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in names],
                         F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")).schema

    def remove(batches):
        for b in batches:
            done = [_kept_words(t, s, window) for t, s in zip(column(b, text).to_pylist(), column(b, "runs").to_pylist(), strict=True)]
            left = pa.array([b" ".join(w) for w, _ in done], pa.binary()).cast(pa.string())
            cols = [left if f"c{i}" == text else column(b, f"c{i}") for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([n for _, n in done], pa.int64()), pa.array([n - len(w) for w, n in done], pa.int64())],
                                             names=[*names, "n_words", "n_removed"])

    return met.mapInArrow(remove, schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT k, min(doc_id) AS a FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
rep AS (SELECT win.doc_id, win.i FROM win JOIN first ON win.k = first.k WHERE first.a < win.doc_id),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM rep),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
stay AS (SELECT word.* FROM word ANTI JOIN cov ON word.doc_id = cov.doc_id AND word.i = cov.i),
j AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM stay GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(j.n, 0) AS n_removed, sha256(coalesce(j.t, '')) AS kept_sha256
FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""
