"""URL filter: host and path rules first, a logistic regression for the rest.

The regression reads hashed character 3- to 5-grams of host and path (each with its own ends and salt)
and is trained in numpy on a small table of labelled URLs that ``labelled_urls`` builds from word lists.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
regression on the empty texts; a path that does not start with the rule's path (also an empty one) does
not fit; of fitting rules the longest wins, of equally long ones the first in order; repeated rows get
equal results; an empty table gives no rows; other columns stay as they are."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import vec
from shelfspark.llm.vec import column

LOG2, SIZES = 14, (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Verdict and rule (host and path) of the registered query
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

# Words of the labelled URLs
_BAD = ("cheap-pills", "free-bets", "spam-farm", "casino-win", "loan-fast", "hot-dates", "poker-bonus", "fake-watches",
        "click-farm", "adult-cams", "lotto-prize", "crypto-double", "weight-loss-now", "cheap-meds", "free-spins", "replica-bags")
_GOOD = ("news", "library", "garden", "weather", "museum", "recipes", "travel", "physics", "history", "wiki", "school", "forum",
         "journal", "city-guide", "open-data", "music")
_ENDS = ("example.com", "example.org", "example.net")


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block) by rule: every word with every ending, in turn with and without a host prefix."""
    out = []
    for label, words in ((1, _BAD), (0, _GOOD)):
        for i, w in enumerate(words):
            for j, end in enumerate(_ENDS):
                host = ("www.", "", "blog.", "m.")[(i + j) % 4] + f"{w}.{end}"
                out.append((host, ("/en/", "/de/", "/fr/", "/es/", "/")[(i + 2 * j) % 5] + str(37 * (i + 1) + j), label))
    for i, (a, b) in enumerate(zip(_GOOD, _GOOD[1:] + _GOOD[:1], strict=True)):         # plain hosts without a known word
        out.append((f"{a[:4]}{b[:4]}.{_ENDS[i % 3]}", f"/en/{i}.html", 0))
        out.append((f"{b[1:4]}{a[:3]}.example.org", f"/{i}/", 0))
    return out + [("", "", 0)]


def _hashes(texts: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text with an end mark on both sides, and their number per text."""
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buf, offs = vec.text_buffer(texts)
    buf, offs = buf[offs[0]:], offs - offs[0]
    size = np.diff(offs)
    flat = np.zeros(len(buf) + 2 * len(size), np.uint64)                    # 0 marks an end
    flat[np.arange(len(buf)) + np.repeat(2 * np.arange(len(size)) + 1, size)] = buf
    row = np.repeat(np.arange(len(size)), size + 2)
    out, rows = [], []
    for n in SIZES:
        h = vec.grams(flat + np.uint64(1 + salt * 1000), n)
        keep = row[: len(h)] == row[n - 1:] if len(h) else np.zeros(0, bool)
        out.append((h[keep] >> np.uint64(64 - LOG2)).astype(np.int64))
        rows.append(row[: len(h)][keep])
    return np.concatenate(out), np.concatenate(rows)


class UrlModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """Probability that a URL is to be blocked."""
        total = np.full(len(hosts), self.bias)
        for salt, texts in enumerate((hosts, paths)):
            f, row = _hashes(texts, salt)
            n = np.bincount(row, minlength=len(hosts))
            total += np.bincount(row, self.weights[salt][f], minlength=len(hosts)) / np.sqrt(np.maximum(n, 1))
        return 1 / (1 + np.exp(-total))


def train(table: list[tuple[str, str, int]] | None = None, epochs: int = 300, rate: float = 0.5, decay: float = 1e-3) -> UrlModel:
    table = labelled_urls() if table is None else table
    y = np.array([r[2] for r in table], float)
    feats = []
    for salt in (0, 1):
        f, row = _hashes(pa.array([r[salt] for r in table], pa.string()), salt)
        feats.append((f, row, 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(table)), 1))))
    w, bias = np.zeros((2, 1 << LOG2)), 0.0
    for _ in range(epochs):
        z = bias + sum(np.bincount(row, w[s][f], minlength=len(table)) * scale for s, (f, row, scale) in enumerate(feats))
        d = (1 / (1 + np.exp(-z)) - y) / len(table)
        for s, (f, row, scale) in enumerate(feats):
            w[s] -= rate * len(table) ** 0.5 * (np.bincount(f, (d * scale)[row], minlength=1 << LOG2) + decay * w[s] / len(table))
        bias -= rate * d.sum()
    return UrlModel(w, float(bias))


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Longest fitting rule, else null."""
    found = F.lit(None).cast("string")
    for _, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        name, cut, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(cut + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES, least: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict (in place of columns so named)."""
    vec.bounded_batches(pages.sparkSession)
    new = ("host", "path", "rule", "score", "verdict")
    names = [c for c in pages.columns if c not in new]
    sent = pages.sparkSession.sparkContext.broadcast(model)
    url = F.col("url").cast("string")
    split = (pages.select(*[F.col(f"`{c}`") for c in names], host_of(url).alias("host"), path_of(url).alias("path"))
             .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)))
    schema = split.withColumn("score", F.lit(0.0).cast("double")).schema

    def run(batches):
        for b in batches:
            yield b.append_column("score", pa.array(sent.value.score(column(b, "host"), column(b, "path")), pa.float64()))

    verdict = F.when(F.col("score") >= least, "block").otherwise("allow")
    for kind, rule in rules:
        verdict = F.when(F.col("rule") == rule, kind).otherwise(verdict)
    return split.mapInArrow(run, schema).withColumn("verdict", verdict)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, train()).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
