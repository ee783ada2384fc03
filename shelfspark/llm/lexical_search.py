"""Ranked lexical search with hashed max-sketches.

A document's impact of a term is the part of the term's score that does not depend on the query; the
terms of a document are hashed to ``COORDS`` coordinates, and its sketch holds the largest impact at each.
The sketches of a slice of documents times the queries' weights by coordinate (one matrix product for a
whole block of queries) are upper bounds of all scores. For each query, documents are rescored exactly in
descending order of their bounds until a bound falls below the k-th best score that the task has found;
each task passes on k documents a query at most, and the best of all tasks rank.

Queries go in blocks of ``BLOCK_TERMS`` terms (one item at least), each block a broadcast and a pass over
the documents. All numbers are integers held in doubles (below 2^53), so bounds and scores are exact.

Cases: null text has no terms; such documents and items count and rank nowhere; items with equal ids are
ranked each on its own; a null item_id stays null; rows that repeat a document rank each on their own, and
rows without a doc_id rank behind others of equal score; other columns are not read; empty tables give no
rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm import vec
from shelfspark.llm.vec import column

U = np.uint64
COORDS = 1 << 12
BLOCK_TERMS = 1 << 14              # terms of a block of queries, with repeats
TOP = 10
ROWS = 512                         # documents of a slice, at most
AT_ONCE = 32                       # documents rescored together
NO_ID = np.iinfo(np.int64).max     # a missing doc_id ranks behind all others
_COUNTS = pa.schema([("h", pa.int64()), ("kind", pa.int32()), ("n", pa.int64())])
_FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _slices(batches, rows: int = ROWS) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """doc_ids, number of rows, row and hash of every term, for slices of documents."""
    for b in batches:
        ids = column(b, "doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
        for lo, hi, buf, offs in vec.slices(column(b, "text")):
            _, _, row, h = vec.words(buf, offs, vec.ALNUM_LUT)
            for at in range(0, hi - lo, rows):
                end = min(hi - lo, at + rows)
                i, j = np.searchsorted(row, (at, end))
                yield ids[lo + at: lo + end], end - at, row[i:j] - at, h[i:j]


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and number of every term of a row."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    return row[first], h[first], np.diff(np.r_[first, len(h)])


class Block:
    """Queries whose terms and weights go to the tasks together."""

    def __init__(self, items: list[tuple[int, np.ndarray]], coords: int = COORDS):
        self.coords = coords                                                     # a power of two
        self.items = [i for i, _ in items]
        self.terms = np.unique(np.concatenate([h for _, h in items]))
        self.counts = [np.unique(h, return_counts=True) for _, h in items]       # a term repeated in an item counts each time

    def weigh(self, n: int, total: int, df: dict[int, int]) -> None:
        """Weights from the number of documents with terms, all their terms, and the documents that hold each term."""
        self.n, self.total = n, total
        w = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(int(h), 0) + 1))) for h in self.terms.view(np.int64)], float)
        at = self.coordinate(self.terms)
        coords = np.unique(at)
        self.coord = np.full(self.coords, -1)
        self.coord[coords] = np.arange(len(coords))
        self.matrix = np.zeros((len(coords), len(self.items)))
        self.columns, self.weights = [], []
        for q, (h, k) in enumerate(self.counts):
            col = np.searchsorted(self.terms, h)
            self.columns.append(col)
            self.weights.append(w[col] * k)
            np.add.at(self.matrix[:, q], self.coord[at[col]], self.weights[q])

    def coordinate(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - (self.coords - 1).bit_length())).astype(np.int64)

    def place(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the block's terms, -1 if it is none."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)


def _statistics(docs: DataFrame, block: Block) -> tuple[int, int, dict[int, int]]:
    """Documents with terms, their terms, documents per term of the block: one row a task and number."""
    terms = docs.sparkSession.sparkContext.broadcast(block.terms)

    def count(batches):
        held = terms.value
        n = total = 0
        df = np.zeros(len(held), np.int64)
        for _, size, row, h in _slices(batches):
            n += int(np.count_nonzero(np.bincount(row, minlength=size)))
            total += len(h)
            at = np.minimum(np.searchsorted(held, h), len(held) - 1)
            hit = held[at] == h
            df += np.bincount(np.unique(row[hit] * len(held) + at[hit]) % len(held), minlength=len(held))
        found = np.flatnonzero(df)
        yield vec.batch_of(_COUNTS, np.r_[0, 0, vec.signed(held[found])], np.r_[1, 2, np.zeros(len(found), int)], np.r_[n, total, df[found]])

    rows = docs.mapInArrow(count, "h long, kind int, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")).collect()   # a row a term of the block
    of = {(r.kind, r.h): r.n for r in rows}
    return of.get((1, 0), 0), of.get((2, 0), 0), {h: n for (kind, h), n in of.items() if kind == 0}


def _blocks(items: DataFrame, coords: int) -> Iterator[tuple[dict[int, int | None], Block]]:
    """Blocks of items, and the item_id of each item number."""
    held, ids, size = [], {}, 0
    for number, r in enumerate(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()):
        buf = np.frombuffer((r.text or "").encode(), np.uint8)
        h = vec.words(buf, np.array([0, len(buf)]), vec.ALNUM_LUT)[3]
        if not len(h):
            continue
        if held and size + len(h) > BLOCK_TERMS:
            yield ids, Block(held, coords)
            held, ids, size = [], {}, 0
        held.append((number, h))
        ids[number] = r.item_id
        size += len(h)
    if held:
        yield ids, Block(held, coords)


class _Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * items

    def add(self, q: int, doc: np.ndarray, score: np.ndarray) -> None:
        doc, score = np.r_[self.held[q][0], doc], np.r_[self.held[q][1], score]
        best = np.lexsort((doc, -score))[: self.k]
        self.held[q] = doc[best], score[best]
        if len(best) == self.k:
            self.least[q] = score[best[-1]]


def _search(block: Block, best: _Best, ids: np.ndarray, size: int, row: np.ndarray, h: np.ndarray) -> int:
    """Bounds of a slice's documents, then exact scores in descending order of the bounds. Returns how many were rescored."""
    length = np.bincount(row, minlength=size)
    m = np.array([25 + 75 * int(x) * block.n // block.total for x in length])        # whole numbers of any size
    row, h, tf = _distinct(row, h)
    coord = block.coord[block.coordinate(h)]
    used = coord >= 0
    row, h, tf, coord = row[used], h[used], tf[used], coord[used]
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
    sketch = np.zeros((size, len(block.matrix)))
    np.maximum.at(sketch, (row, coord), impact)
    bounds = sketch @ block.matrix
    place = block.place(h)
    hit = place >= 0
    exact = np.zeros((size, len(block.terms)))
    exact[row[hit], place[hit]] = impact[hit]
    rescored = 0
    may = (bounds > 0) & (bounds >= best.least)
    for q in np.flatnonzero(may.any(axis=0)).tolist():
        doc = np.flatnonzero(may[:, q])
        doc = doc[np.argsort(-bounds[doc, q], kind="stable")]
        for at in range(0, len(doc), AT_ONCE):
            some = doc[at: at + AT_ONCE]
            some = some[bounds[some, q] >= best.least[q]]                            # an equal score may rank by its smaller doc_id
            if not len(some):
                break
            score = exact[some[:, None], block.columns[q]] @ block.weights[q]
            rescored += len(some)
            some, score = some[score > 0], score[score > 0]
            best.add(q, ids[some], score.astype(np.int64))
    return rescored


def search(docs: DataFrame, items: DataFrame, top: int = TOP, coords: int = COORDS, rows: int = ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item; ``coords`` coordinates of a sketch (a power of
    two), at most ``rows`` documents in a slice."""
    spark = docs.sparkSession
    vec.bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = []
    for ids, block in _blocks(items, coords):
        n, total, df = _statistics(docs, block)
        if not total:
            continue
        block.weigh(n, total, df)
        shared = spark.sparkContext.broadcast(block)

        def task(batches, shared=shared):
            block = shared.value
            best = _Best(len(block.items), top)
            for ids, size, row, h in _slices(batches, rows):
                _search(block, best, ids, size, row, h)
            for i, (doc, score) in zip(block.items, best.held, strict=True):
                if len(doc):
                    yield vec.batch_of(_FOUND, np.full(len(doc), i), pa.array(doc, pa.int64(), mask=doc == NO_ID), score)

        w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = (docs.mapInArrow(task, "item long, doc_id long, score long").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top))
        names = spark.createDataFrame([(number, item) for number, item in ids.items()], "item long, item_id long")      # a block's items
        parts.append(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
l AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM l),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS k FROM i GROUP BY 1, 2),
r AS (SELECT q.item_id, f.doc_id, sum(q.k * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (100 - 75 + ((75 * l.n * s.docs) // s.total)))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN l USING (doc_id), s GROUP BY 1, 2),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
