"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

Test items are cut into units of at most ``UNIT`` words and indexed: for each term its postings, their
largest weight, and their largest weight in each block of units. A weight is the term's BM25 share of
the unit's score for itself, so a passage that holds a whole unit scores 1. Every document is cut into
passages of 2 x ``UNIT`` words, half over half, so a run of a unit's length lies whole in one. Each
passage is a query: first numpy bounds it by the terms' largest weights and by those of each block;
passages that may reach the threshold go through block-max WAND over the postings. A unit found makes
its item a candidate, which is verified on the document: the share of the word n-grams of the item's
question and of its answer that the document holds.

The index is built on the driver from distinct items of at most ``SHARD_WORDS`` words together and
broadcast; postings and block maxima are sparse, so its size follows these words. More words make more
shards, each its own pass. Words are runs of letters and digits, A-Z lower-cased, other ASCII dropped.

Cases: null and empty texts have no passages; items without an answer column are cut into question and
answer at the last line break, else the last sentence end, else in the middle; an item of fewer than
``LEAST_WORDS`` words is found where it stands verbatim (white space aside) between other words, an item of
one word where it is a whole line, and an item without words nowhere; an item longer than a shard is a shard
of its own; repeated items and rows are each judged; a null doc_id stays null in the result, and so does
an item_id that is null or no whole number; empty tables give no rows."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import vec
from shelfspark.llm.tables import written_table
from shelfspark.llm.vec import batch_of, column

U = np.uint64
UNIT, BLOCK, SHARD_WORDS, LEAST_WORDS, GRAM = 64, 4, 1 << 20, 5, 5
CELLS = 1 << 16                             # passages by blocks that are bounded at once
K1, B = 1.2, 0.75
SCORE, OVERLAP = 0.6, 0.5
_FOUND = pa.schema([("doc_id", pa.int64()), ("item", pa.string()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return vec.words(raw, np.array([0, len(raw)]), vec.ALNUM_LUT)[3]


def _halves(text: str) -> tuple[str, str]:
    """Question and answer of an item that has only a text."""
    text = text.strip()
    for cut in (text.rfind("\n"), max((m.end() for m in re.finditer(r"[.?!]\s", text)), default=-1)):
        if 0 < cut < len(text) and len(_hashes(text[:cut])) and len(_hashes(text[cut:])):
            return text[:cut], text[cut:]
    words = text.split()
    return " ".join(words[: -(-len(words) // 2)]), " ".join(words[-(-len(words) // 2):])


def _grams(h: np.ndarray) -> np.ndarray:
    return np.unique(vec.grams(h, min(GRAM, len(h)))) if len(h) else np.zeros(0, U)


class Lists:
    """A list of (number, weight) for each of ``n`` keys, numbers ascending."""

    def __init__(self, n: int, keys: np.ndarray, numbers: np.ndarray, weights: np.ndarray):
        order = np.lexsort((numbers, keys))
        self.numbers, self.weights = numbers[order], weights[order]
        self.start = np.searchsorted(keys[order], np.arange(n + 1))

    def __getitem__(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.start[key], self.start[key + 1])
        return self.numbers[part], self.weights[part]

    def sums(self, keys: np.ndarray, group: np.ndarray, groups: int, n: int) -> np.ndarray:
        """Sum of the weights of each of ``n`` numbers over the lists of each group's ``keys``."""
        size = self.start[keys + 1] - self.start[keys]
        at = np.repeat(self.start[keys] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(np.repeat(group * n, size) + self.numbers[at], self.weights[at], groups * n).reshape(groups, n)


class Index:
    """Inverted index of test items (item, question, answer)."""

    def __init__(self, items: list[tuple[str | int, str, str]]):
        self.items, units, of = [], [], []
        self.short: dict[int, dict[int, list]] = {}                          # words -> hash of the phrase -> items and patterns
        for item_id, question, answer in items:
            q, a = _hashes(question), _hashes(answer)
            h = np.concatenate([q, a])
            if len(h) < LEAST_WORDS:
                if len(h):
                    phrase = r"\s+".join(map(re.escape, f"{question} {answer}".split()))
                    pattern = rf"(?<!\w){phrase}(?!\w)" if len(h) > 1 else rf"(?m)^\s*{phrase}\s*$"
                    self.short.setdefault(len(h), {}).setdefault(int(vec.grams(h, len(h))[0]), []).append((item_id, re.compile(pattern)))
                continue
            for start in range(0, len(h), UNIT):
                units.append(h[max(0, min(start, len(h) - UNIT)): start + UNIT])
                of.append(len(self.items))
            self.items.append((item_id, len(q), _grams(q), len(a), _grams(a)))
        self.item_of = of
        average = np.mean([len(u) for u in units]) if units else 1.0
        n = len(units)
        counts = [np.unique(u, return_counts=True) for u in units]
        none = np.zeros(0, np.int64)
        self.terms, df = np.unique(np.concatenate([t for t, _ in counts]), return_counts=True) if units else (np.zeros(0, U), none)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        places, weights = [none], [np.zeros(0)]
        for (t, tf), words in zip(counts, units, strict=True):
            places.append(np.searchsorted(self.terms, t))
            w = idf[places[-1]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / average))
            weights.append(w / w.sum())
        term, weight = np.concatenate(places), np.concatenate(weights)
        unit = np.repeat(np.arange(n), [len(t) for t, _ in counts])
        self.postings = Lists(len(self.terms), term, unit, weight)
        self.blocks = -(-n // BLOCK)
        width = max(1, self.blocks)
        cell, back = np.unique(term * width + unit // BLOCK, return_inverse=True)
        best = np.zeros(len(cell))
        np.maximum.at(best, back, weight)
        self.block_max = Lists(len(self.terms), cell // width, cell % width, best)
        self.top = np.zeros(len(self.terms))
        np.maximum.at(self.top, term, weight)
        # place of a term by the top bits of its hash, then by search among the few that share them
        self.shift = U(64 - 16)
        self.slots = np.searchsorted(self.terms >> self.shift, np.arange((1 << 16) + 1, dtype=U))
        self.deepest = int(np.diff(self.slots).max()) if len(self.terms) else 0

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Number of each word's term, -1 for words of no item."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> self.shift).astype(np.int64)
        lo, hi = self.slots[slot], self.slots[slot + 1]
        for k in range(self.deepest):
            at = np.flatnonzero(lo + k < hi)
            hit = at[self.terms[lo[at] + k] == h[at]]
            out[hit] = lo[hit] + k
        return out

    def bounds(self, terms: np.ndarray, passage: np.ndarray, passages: int) -> np.ndarray:
        """For each passage the sum of its terms' largest weights in each block, not less than the score of any of its units."""
        return self.block_max.sums(terms, passage, passages, self.blocks) + 1e-9

    def wand(self, terms: list[int], bounds: np.ndarray, least: float) -> list[tuple[int, float]]:
        """Units that score ``least`` or more, by block-max WAND; of the postings only those in open blocks are taken up."""
        fits = bounds >= least
        lists = []
        for u, w in map(self.postings.__getitem__, terms):
            kept = fits[u // BLOCK]
            lists.append((u[kept].tolist(), w[kept].tolist()))
        tops = [float(self.top[t]) + 1e-12 for t in terms]
        out, cursor = [], [0] * len(lists)
        open_ = (np.flatnonzero(fits) * BLOCK).tolist()                      # first units of the blocks that can reach it

        def forward(k: int, unit: int) -> None:
            cursor[k] = bisect_left(lists[k][0], unit, cursor[k])

        if not open_:
            return out
        for k in range(len(lists)):
            forward(k, open_[0])
        while True:
            live = sorted([(lists[k][0][c], k) for k, c in enumerate(cursor) if c < len(lists[k][0])])
            bound, pivot = 0.0, -1
            for i, (_, k) in enumerate(live):
                bound += tops[k]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                return out
            unit = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == unit:
                pivot += 1
            at = bisect_left(open_, unit - unit % BLOCK)
            if at == len(open_):
                return out
            if open_[at] > unit:                                             # a block that cannot reach it: on to the next that can
                for u, k in live:
                    if u < open_[at]:
                        forward(k, open_[at])
            elif live[0][0] == unit:
                score = sum(lists[k][1][cursor[k]] for _, k in live[: pivot + 1])
                if score >= least - 1e-9:
                    out.append((unit, score))
                for _, k in live[: pivot + 1]:
                    cursor[k] += 1
            else:
                for u, k in live[: pivot + 1]:
                    if u < unit:
                        forward(k, unit)

    def candidates(self, row: np.ndarray, h: np.ndarray, least: float) -> dict[tuple[int, int], float]:
        """Best score of each (row, item) that a passage reaches ``least`` with."""
        term = self.lookup(h)
        first = np.searchsorted(row, row)
        half = (np.arange(len(row)) - first) // UNIT                         # a word lies in passages half - 1 and half
        known = np.flatnonzero(term >= 0)
        if not len(known):
            return {}
        n = len(self.terms)
        r, p, t = row[known], half[known], term[known]
        width = int(p.max()) + 2
        key = np.unique(np.concatenate([(r * width + p) * n + t, (r * width + p + 1) * n + t]))      # distinct terms of each passage
        passage, t = key // n, key % n
        start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        end = np.r_[start[1:], len(t)]
        found: dict[tuple[int, int], float] = {}
        live = np.flatnonzero(np.add.reduceat(self.top[t], start) >= least - 1e-9)
        step = max(1, CELLS // self.blocks)
        for some in (live[i: i + step] for i in range(0, len(live), step)):
            size = end[some] - start[some]
            own = np.repeat(np.arange(len(some)), size)
            terms = t[np.repeat(start[some] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            bounds = self.bounds(terms, own, len(some))
            for k in np.flatnonzero(bounds.max(1) >= least).tolist():
                i = some[k]
                for unit, score in self.wand(t[start[i]: end[i]].tolist(), bounds[k], least):
                    at = (int(passage[start[i]]) // width, self.item_of[unit])
                    found[at] = max(found.get(at, 0.0), score)
        return found

    def phrases(self, row: np.ndarray, h: np.ndarray, text_of) -> list[tuple[int, str | int]]:
        """(row, item) of the short items that stand in a row's text; hashes find the candidates."""
        out = set()
        for k, wanted in self.short.items():
            if len(h) >= k:
                found = vec.grams(h, k)
                at = np.flatnonzero(np.isin(found, np.array(list(wanted), U)))
                for r, g in sorted(set(zip(row[at].tolist(), found[at].tolist(), strict=True))):
                    out.update((r, item) for item, pattern in wanted[g] if pattern.search(text_of(r)))
        return sorted(out)

    def search(self, texts: pa.Array, least: float = SCORE, overlap: float = OVERLAP) -> list[tuple[int, str | int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of verified items."""
        out = []
        if not self.items and not self.short:
            return out
        for lo, _, buf, offs in vec.slices(texts):
            _, _, row, h = vec.words(buf, offs, vec.ALNUM_LUT)
            out += [(lo + r, item, 1.0, 1.0, 1.0) for r, item in self.phrases(row, h, lambda r, lo=lo: texts[lo + r].as_py())]
            held: dict[int, dict[int, np.ndarray]] = {}
            for (r, item), score in sorted(self.candidates(row, h, least).items()):
                own = h[np.searchsorted(row, r): np.searchsorted(row, r, "right")]
                item_id, nq, q, na, a = self.items[item]
                grams = held.setdefault(r, {})
                shares = []
                for n, g in ((nq, q), (na, a)):
                    k = min(GRAM, n)
                    if k and k not in grams:
                        grams[k] = np.unique(vec.grams(own, k))
                    shares.append(float(np.isin(g, grams[k]).mean()) if k else 1.0)
                if min(shares) >= overlap:
                    out.append((lo + r, item_id, score, *shares))
        return out


def _items(benchmark: DataFrame) -> tuple[DataFrame, list[str]]:
    """(item_id, item, question, answer) or (item_id, item, text): ``item`` is a digest of what an item says; and the columns that say it."""
    cols = ["question", "answer"] if {"question", "answer"} <= set(benchmark.columns) else ["text"]
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]
    items = benchmark.select(F.col("item_id").cast("string").try_cast("long").alias("item_id"), *said)
    return items.withColumn("item", F.sha2(F.to_json(F.struct(*cols)), 256)), cols


def shards(benchmark: DataFrame, words: int = SHARD_WORDS):
    """Indexes over the distinct items, each of items with at most ``words`` words together (or of one longer item). The
    driver holds one partition of the items and one shard at a time, however many items there are."""
    items, cols = _items(benchmark)
    items = written_table(items.select("item", *cols).dropDuplicates(["item"]), "items")
    shard, held = [], 0
    for r in items.toLocalIterator():
        pair = (r.question, r.answer) if len(cols) == 2 else _halves(r.text)
        n = len(_hashes(pair[0])) + len(_hashes(pair[1]))
        if shard and held + n > words:
            yield Index(shard)
            shard, held = [], 0
        shard.append((r["item"], *pair))
        held += n
    if shard:
        yield Index(shard)


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SCORE, overlap: float = OVERLAP, words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): each item that a document holds."""
    vec.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = docs.sparkSession.createDataFrame([], "doc_id long, item string, score double, question_overlap double, answer_overlap double")
    for index in shards(benchmark, words):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in batches:
                hits = sent.value.search(column(b, "text"), least, overlap)
                rows = column(b, "doc_id").take(pa.array([x[0] for x in hits], pa.int64()))
                yield batch_of(_FOUND, rows, *([x[i] for x in hits] for i in range(1, 5)))

        found = found.unionByName(docs.mapInArrow(run, found.schema))
    return found.join(_items(benchmark)[0].select("item", "item_id"), "item").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SCORE, overlap: float = OVERLAP, words: int = SHARD_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no test item. Of several shards each is a pass over what the one before kept, so that
    a worker holds one index at a time."""
    vec.bounded_batches(docs.sparkSession)
    for number, index in enumerate(shards(benchmark, words)):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        if number:
            docs = written_table(docs, "unleaked")

        def run(batches, sent=sent):
            for b in batches:
                hits = {x[0] for x in sent.value.search(column(b, "text").cast(pa.string()), least, overlap)}
                yield b.filter(pa.array([i not in hits for i in range(len(b))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
