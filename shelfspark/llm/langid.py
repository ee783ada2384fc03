"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are its byte 3- and 4-grams (lower-cased A-Z, runs of other ASCII as one separator
class), hashed into ``BUCKETS`` rows of an embedding; their mean goes through a linear layer. Embedding
and layer are trained in numpy by stochastic gradient descent on a bounded sample of labelled documents
(``PER_LANG`` per language, least hash of doc_id first). Because the model is linear in the mean, a task
needs only each bucket's score per language. A fifth of the sample is held out to fit the softmax's
temperature and the confidence below which a prediction is marked as rejected (``accepted`` false).

Cases: null text, empty text and text without a letter are ``und`` with score 0, and not accepted; a
null doc_id is never learned from; without any labelled row every text is ``und``; repeated rows get
equal results; of equal scores the language first in order wins; an empty table gives no rows; lang,
source and doc_id are not read in a prediction."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm import vec
from shelfspark.llm.vec import column

U = np.uint64
BUCKETS, DIM = 1 << 15, 16
PER_LANG, SALTS = 600, 16      # labelled documents learned from, of each language
EPOCHS, RATE = 6, 0.5
TARGET = 0.99                  # share of right answers among accepted ones
GAP = 3                        # separators between texts, so that no n-gram reaches into the next


def _buckets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (2, bytes) of the 3- and 4-gram at each place, and [from, to) of each row, as one flat array."""
    size = np.diff(offs)
    flat = np.full(len(buf) + GAP * (len(size) + 1), 32, np.uint32)
    at = np.arange(len(buf)) + np.repeat(GAP * np.arange(1, len(size) + 1), size)
    flat[at] = vec.ALNUM_LUT[buf]
    three = (flat[:-3] << np.uint32(16)) ^ (flat[1:-2] << np.uint32(8)) ^ flat[2:-1]
    four = (three << np.uint32(8)) ^ flat[3:]
    shift = np.uint32(32 - (BUCKETS - 1).bit_length())
    grams = np.stack([(three * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)) >> shift, (four * np.uint32(0x85EBCA6B)) >> shift])
    first = offs[:-1] + GAP * np.arange(1, len(size) + 1) - 1        # from the separator before the text
    return grams, np.stack([first, first + size + 1], 1).ravel()


def _means(grams: np.ndarray, edge: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean of table[bucket] over each row's n-grams."""
    total = np.add.reduceat(table[grams[0]] + table[grams[1]], np.minimum(edge, grams.shape[1] - 1), axis=0)[::2]
    return total / (2 * (edge[1::2] - edge[::2]))[:, None]


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.langs, self.table, self.bias, self.temperature, self.least = langs, table, bias, temperature, least

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float], list[bool]]:
        names, scores, taken = [], [], []
        for lo, hi, buf, offs in vec.slices(texts):
            raw = texts.slice(lo, hi - lo).to_pylist()
            if self.langs:
                p = _softmax((_means(*_buckets(buf, offs), self.table) + self.bias) / self.temperature)
                best = p.argmax(1)
            for i, t in enumerate(raw):
                if not self.langs or not t or not any(map(str.isalpha, t)):
                    names.append("und"), scores.append(0.0), taken.append(False)
                else:
                    s = float(p[i, best[i]])
                    names.append(self.langs[best[i]]), scores.append(s), taken.append(s >= self.least)
        return names, scores, taken


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Trains on four fifths and calibrates on the rest (on all, where the rest would be empty)."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    y = np.searchsorted(langs, labels)
    bags = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        grams, (a, b) = _buckets(raw, np.array([0, len(raw)]))
        ids, n = np.unique(grams[:, a:b], return_counts=True)
        bags.append((ids, (n / n.sum()).astype(np.float32)))
    order = rng.permutation(len(y))
    held = order[: len(y) // 5] if len(y) >= 10 else order
    train = order[len(y) // 5:] if len(y) >= 10 else order
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(train):
            ids, share = bags[i]
            mean = share @ e[ids]
            g = _softmax((mean @ w + bias)[None])[0]
            g[y[i]] -= 1
            back = w @ g
            w -= rate * np.outer(mean, g)
            bias -= rate * 0.1 * g
            e[ids] -= (rate * len(ids) ** 0.5) * share[:, None] * back
    table = (e @ w).astype(np.float32)
    logits = np.array([share @ table[ids] + bias for ids, share in (bags[i] for i in held)])
    right = y[held]
    temperature = min((0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0),
                      key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(right)), right] + 1e-12).mean())
    p = _softmax(logits / temperature)
    by = np.argsort(-p.max(1), kind="stable")
    share = np.cumsum(p.argmax(1)[by] == right[by]) / np.arange(1, len(by) + 1)
    good = np.flatnonzero(share >= TARGET)
    least = float(p.max(1)[by][good[-1]]) if len(good) else 1.0
    return Model(langs, table, bias, temperature, least)


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(text, lang) of at most ``per_lang`` documents of each language, chosen by hash of doc_id."""
    key = F.xxhash64(F.col("doc_id"))
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    ids = known.select("doc_id", "lang", F.pmod(key, F.lit(SALTS)).alias("salt"))
    for part in (["lang", "salt"], ["lang"]):          # least by salt, then of those: at most SALTS * per_lang rows meet in a task
        ids = ids.withColumn("n", F.row_number().over(Window.partitionBy(*part).orderBy(key, "doc_id"))).filter(F.col("n") <= per_lang)
    ids = ids.select("doc_id").distinct()
    # at most per_lang ids of each language: a bounded list to broadcast
    return known.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text", "lang")


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    rows = sorted(training_rows(docs, per_lang).collect(), key=lambda r: (r.doc_id, r.lang, r.text))
    rows = [r for r in rows if any(map(str.isalpha, r.text))]
    return fit([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted (in place of columns so named)."""
    vec.bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    new = ("lang_pred", "score", "accepted")
    names = [c for c in docs.columns if c not in new]
    schema = docs.select(*[F.col(f"`{c}`") for c in names], F.lit("").alias(new[0]), F.lit(0.0).alias(new[1]), F.lit(True).alias(new[2])).schema

    def run(batches):
        for b in batches:
            lang, score, accepted = sent.value.predict(column(b, text))
            yield pa.RecordBatch.from_arrays([*[column(b, c) for c in names], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                                             names=[*names, *new])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "lang")
    model = train(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
