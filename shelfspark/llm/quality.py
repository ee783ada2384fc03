"""Quality classifier by importance resampling, and toxicity by a text's worst words.

Two generative models of hashed word uni- and bigrams, one of target text (documents labelled good and
not toxic), one of all text, give each document the mean log ratio per n-gram. Its log weight is that
mean for a document of ``LENGTH`` n-grams; with Gumbel noise drawn from a hash of doc_id, the k largest
keys are a sample without replacement by weight. k is the number of documents whose mean ratio reaches
the level that ``KEEP`` of held-out good documents reach and that are not toxic.

A mean over a whole text drowns a few words, so toxicity is judged apart: each word has the log ratio of
toxic to good labelled documents that hold it, and a text's toxicity is the mean of its ``WORST`` highest
positive ratios. A text over the limit that ``CLEAN`` of held-out good documents keep is not sampled.

All n-gram counts cover all documents. Learned from labels, with a documented bound: at most ``TARGETS``
target documents, as many toxic ones, and ``HELD`` held-out ones, least hash of doc_id first.

Cases: a text without words (null, empty, blank) has no weight and is rejected; without labelled good
documents nothing else is rejected, without labelled toxic ones nothing is toxic; a doc_id with several labels counts by its worst; rows of one doc_id
and text share a key, and all rows with the k-th key are taken; null labels count as not good; an empty
table gives no rows; other columns stay as they are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import vec
from shelfspark.llm.vec import batch_of, column
from shelfspark.session import cut_lineage

U = np.uint64
LOG2, CHUNKS = 18, 64
TARGETS, HELD, KEEP = 20_000, 5_000, 0.998
LENGTH, SEED = 400, 17
WORD_LOG2, WORST, CLEAN = 20, 2, 0.99
_COUNTS = pa.schema([("chunk", pa.int32()), ("raw", pa.binary()), ("target", pa.binary())])
_WORDS = pa.schema([("word", pa.int32()), ("toxic", pa.int64()), ("good", pa.int64())])


def _features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word and of each pair of neighbours."""
    _, _, row, h = vec.words(buf, offs)
    two = vec.grams(h, 2)
    same = row[1:] == row[:-1]
    f = np.concatenate([h, two[same]]) >> U(64 - LOG2)
    return f.astype(np.int64), np.concatenate([row, row[1:][same]])


def _held_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each word, once a row; case and marks are not regarded."""
    _, _, row, h = vec.words(buf, offs, vec.ALNUM_LUT)
    held = np.unique(row << WORD_LOG2 | (h >> U(64 - WORD_LOG2)).astype(np.int64))
    return held >> WORD_LOG2, held & ((1 << WORD_LOG2) - 1)


def _labelled(labels: DataFrame) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Sorted doc_ids of the target, those held out, and sorted doc_ids of toxic documents. A quarter of both kinds is held out."""
    known = (labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
            .select("doc_id", F.expr("q = 1 AND t = 0").alias("good"), F.expr("t = 1").alias("toxic"), F.xxhash64("doc_id").alias("h")))
    good, toxic = known.filter("good"), known.filter("toxic")
    part = F.pmod("h", F.lit(4)) == 0
    first = lambda df, n: [r.doc_id for r in df.orderBy("h", "doc_id").limit(n).collect()]       # noqa: E731
    return (np.array(sorted(first(good.filter(~part), TARGETS)), np.int64), first(good.filter(part), HELD),
            np.array(sorted(first(toxic.filter(~part), TARGETS)), np.int64))


class RatioModel:
    """Log ratio of target to raw by bucket, None without a target."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        size = len(raw)
        self.ratio = None if not target.sum() else (
            np.log((target + 1) / (target.sum() + size)) - np.log((raw + 1) / (raw.sum() + size)))

    def means(self, texts: pa.Array) -> pa.Array:
        """Mean log ratio of each text, null for one without words."""
        out = []
        for lo, hi, buf, offs in vec.slices(texts):
            f, row = _features(buf, offs)
            n = np.bincount(row, minlength=hi - lo)
            total = np.zeros(hi - lo) if self.ratio is None else np.bincount(row, self.ratio[f], minlength=hi - lo)
            out.append(pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0))
        return pa.concat_arrays(out) if out else pa.array([], pa.float64())


class ToxicModel:
    """Log ratio of toxic to good documents by word, None without both kinds. A word that no labelled document holds has ratio 0."""

    def __init__(self, word: np.ndarray, toxic: np.ndarray, good: np.ndarray, n_toxic: int, n_good: int):
        self.ratio = None
        if n_toxic and n_good:
            share = n_toxic / (n_toxic + n_good)
            self.ratio = np.zeros(1 << WORD_LOG2)
            self.ratio[word] = np.log((toxic + share) / n_toxic) - np.log((good + 1 - share) / n_good)

    def worst(self, texts: pa.Array) -> pa.Array:
        """Mean of the ``WORST`` highest positive ratios of each text's words; one that is missing counts as 0."""
        if self.ratio is None:
            return pa.array(np.zeros(len(texts)))
        out = []
        for lo, hi, buf, offs in vec.slices(texts):
            row, word = _held_words(buf, offs)
            x = self.ratio[word]
            row, x = row[x > 0], x[x > 0]
            order = np.lexsort((-x, row))
            row, x = row[order], x[order]
            top = np.arange(len(row)) - np.searchsorted(row, row) < WORST
            out.append(pa.array(np.bincount(row[top], x[top], minlength=hi - lo) / WORST))
        return pa.concat_arrays(out) if out else pa.array([], pa.float64())


def fit_toxic(docs: DataFrame, toxic: np.ndarray, good: np.ndarray) -> ToxicModel:
    """Counts the documents of ``toxic`` and ``good`` that hold a word."""
    if not len(toxic) or not len(good):
        return ToxicModel(*[np.zeros(0, np.int64)] * 3, 0, 0)
    vec.bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((toxic, good))

    def count(batches):
        counts, n = np.zeros((2, 1 << WORD_LOG2), np.int64), [0, 0]
        for b in batches:
            b = b.filter(column(b, "doc_id").is_valid())
            ids = column(b, "doc_id").to_numpy(zero_copy_only=False)
            for k, kind in enumerate(sent.value):
                texts = column(b.filter(pa.array(np.isin(ids, kind))), "text")
                n[k] += len(texts)
                for _, _, buf, offs in vec.slices(texts):
                    word, held = np.unique(_held_words(buf, offs)[1], return_counts=True)
                    counts[k, word] += held
        some = np.flatnonzero(counts.any(0))
        yield batch_of(_WORDS, np.r_[-1, some], *[np.r_[n[k], counts[k, some]] for k in range(2)])          # -1: all documents

    rows = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "word int, toxic long, good long")
            .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("good").alias("good")).toArrow())    # at most 2^WORD_LOG2 + 1
    word, bad, fine = (rows.column(i).to_numpy() for i in range(3))
    return ToxicModel(word[word >= 0], bad[word >= 0], fine[word >= 0], int(bad[word < 0].sum()), int(fine[word < 0].sum()))


def fit(docs: DataFrame, target: np.ndarray) -> RatioModel:
    """Counts n-grams over all ``docs`` and over those whose doc_id is in ``target``."""
    vec.bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(target)
    size = 1 << LOG2
    schema = "chunk int, raw binary, target binary"

    def count(batches):
        raw, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            ids = column(b, "doc_id")
            known = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), sent.value) & ids.is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in vec.slices(column(b, "text")):
                f, row = _features(buf, offs)
                raw += np.bincount(f, minlength=size)
                good += np.bincount(f[known[lo:hi][row]], minlength=size)
        yield batch_of(_COUNTS, list(range(CHUNKS)), [x.tobytes() for x in np.split(raw, CHUNKS)], [x.tobytes() for x in np.split(good, CHUNKS)])

    def add(batches):
        of: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for c, *parts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                now = [np.frombuffer(x, np.int64) for x in parts]
                of[c] = [x + y for x, y in zip(of[c], now, strict=True)] if c in of else now
        for c, (raw, good) in of.items():
            yield batch_of(_COUNTS, [c], [raw.tobytes()], [good.tobytes()])

    rows = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, schema)
            .repartitionById(CHUNKS, "chunk").mapInArrow(add, schema).collect())                   # two tables of 2^LOG2 counts
    raw, good = np.zeros((CHUNKS, size // CHUNKS), np.int64), np.zeros((CHUNKS, size // CHUNKS), np.int64)
    for r in rows:
        raw[r.chunk], good[r.chunk] = np.frombuffer(r.raw, np.int64), np.frombuffer(r.target, np.int64)
    return RatioModel(raw.ravel(), good.ravel())


def with_scores(docs: DataFrame, model: RatioModel, toxic: ToxicModel, text: str = "text", mean: str = "mean_log_ratio", toxicity: str = "toxicity") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((model, toxic))
    names = [c for c in docs.columns if c not in (mean, toxicity)]
    schema = docs.select(*[F.col(f"`{c}`") for c in names], *[F.lit(0.0).cast("double").alias(c) for c in (mean, toxicity)]).schema
    schema[mean].nullable = schema[toxicity].nullable = True

    def run(batches):
        for b in batches:
            texts = column(b, text).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*[column(b, c) for c in names], sent.value[0].means(texts), sent.value[1].worst(texts)], names=[*names, mean, toxicity])

    return docs.mapInArrow(run, schema)


def gumbel_key(mean: str, doc_id: str = "doc_id") -> Column:
    """Log weight plus Gumbel noise that depends on doc_id alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.lit(SEED)), 11) + 0.5) / float(1 << 53)
    return F.col(f"`{mean}`") * LENGTH - F.log(-F.log(u))


def kth_largest(df: DataFrame, key: str, k: int) -> float:
    """The k-th largest of a double column, found by bits: counts by bin, refined within one bin."""
    if k <= 0:
        return float("inf")
    top = df.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    if top.a is None:
        return float("-inf")
    lo, hi, bins = top.a, top.b, 4096
    while True:
        width = (hi - lo) / bins
        held = df.filter(F.col(key).between(lo, hi))
        if width <= 0 or lo + width <= lo:                      # equal, or neighbours, as doubles
            return lo
        rows = held.groupBy(F.least(F.floor((F.col(key) - lo) / width), F.lit(bins - 1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).collect()      # at most ``bins``
        rows.sort(key=lambda r: -r.bin)
        for r in rows:
            if k <= r.n:
                lo, hi = r.a, r.b
                if r.n == 1 or lo == hi:
                    return lo
                break
            k -= r.n
        else:
            return top.a


class Selection:
    """Model and cut over all of ``docs``: what ``choose`` takes."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        target, held, toxic = _labelled(labels)
        self.model, self.toxic = fit(docs, target), fit_toxic(docs, toxic, target)
        scored = with_scores(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), self.model, self.toxic).drop("text")
        self.scored = cut_lineage(scored.withColumn("key", gumbel_key("mean_log_ratio")))
        known = (self.scored.filter(F.col("doc_id").isin(held) & F.col("mean_log_ratio").isNotNull())
                 .select("mean_log_ratio", "toxicity").collect()) if held else []                         # at most HELD documents
        means, worst = sorted(r[0] for r in known), sorted((r[1] for r in known), reverse=True)
        self.level = means[int((1 - KEEP) * len(known))] if known and self.model.ratio is not None else float("-inf")
        self.limit = worst[int((1 - CLEAN) * len(known))] if known else float("inf")
        fit_for = self.scored.filter(F.col("key").isNotNull() & (F.col("toxicity") <= self.limit))
        self.k = fit_for.filter(F.col("mean_log_ratio") >= self.level).count()
        self.cut = kth_largest(fit_for, "key", self.k)
        self.sample = fit_for.filter(F.col("key") >= self.cut)

    def choose(self, docs: DataFrame) -> DataFrame:
        """The sampled rows of ``docs``. Scores are made anew in place, so that no text is shuffled."""
        names = docs.columns
        plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])      # no name can clash
        scored = with_scores(plain, self.model, self.toxic, f"c{names.index('text')}", "mean", "toxicity")
        return (scored.filter((gumbel_key("mean", f"c{names.index('doc_id')}") >= self.cut) & (F.col("toxicity") <= self.limit))
                .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)]))


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: one row per document taken."""
    chosen = Selection(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return chosen.sample.select("doc_id", "mean_log_ratio", F.col("key").alias("gumbel_key"))
