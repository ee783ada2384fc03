"""Language-model scoring with a log-frequency Bloom filter.

N-gram counts of the learned documents are quantised to levels (``BASE`` to the power of the level less
one), and a gram of level L is put into the filter as L keys (gram, 1) to (gram, L). A count is read back by
probing for (gram, 1), (gram, 2), ... until one is missing: never too low, sometimes a level too high. The
filter is made in segments, dealt by hash; each is sized by what it holds, so it grows with the corpus.

A text's probability is the product over its tokens of count-smoothed estimates,
p_k(w | h) = (min(c(h w), c(h)) + PRIOR * p_{k-1}(w | h')) / (c(h) + PRIOR), down to (c(w) + 1) / (N + V + 1).
Up to ``BROADCAST_BYTES`` the filter is broadcast. A larger one stays dealt by segments, and the grams of blocks of texts
are sent to their segments and back, each once a block; the numbers are the same.

The base score needs exact counts: the ``HEAD`` most frequent tokens are broadcast, all others meet their
counts in a join, which has no hot keys without these.

Cases: null and empty texts have the end as their only token; documents without a doc_id are scored, not
learned from, and not held out; each of repeated rows counts and is scored on its own; with nothing to learn
from every count is 0; other columns are not read; an empty table gives no rows."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import vec
from shelfspark.llm.tables import written_table
from shelfspark.llm.vec import column

U = np.uint64
ORDER = 2
PRIOR = 4.0
BASE = 1.5
KEY_BITS, PROBES = 8, 3                # bits of the filter a key, bits set for it
BROADCAST_BYTES = 128 << 20            # largest filter that is sent whole to every worker
HEAD = 1 << 16                         # tokens whose exact counts are broadcast
LEAST_SEGMENTS = 6                     # 64 segments, as a power of two
HELD = 1 << 22                         # grams that a task holds before it adds them up
BLOCK = 1 << 18                        # tokens of texts whose grams go to the segments together
ROUNDS = 3                             # shares of the blocks, one after another: their shuffles are the most that is on disk
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
END = b" "                             # as a token; no word has a blank
_START, _STOP = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
_SALT = [U(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xDB4F0B9175AE2165)]
_TOKENS = pa.schema([("token", pa.binary()), ("c", pa.int64())])
_GRAMS = pa.schema([("segment", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
_PROBE = pa.schema([("segment", pa.int32()), ("row", pa.int64()), ("grams", pa.binary())])
_LEVELS = pa.schema([("row", pa.int64()), ("segment", pa.int32()), ("levels", pa.binary())])
_ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
                   ("rest", pa.list_(pa.struct([("token", pa.binary()), ("k", pa.int64())]))), ("line", pa.binary()), ("at", pa.binary()), ("edge", pa.binary())])


# --- tokens and grams of slices of texts -----------------------------------------------------------

def _slices(texts: pa.Array):
    """(first row, end row, lower-cased bytes, starts, ends, row, hash of every word)."""
    for lo, hi, buf, offs in vec.slices(texts):
        yield lo, hi, vec.LOWER_LUT[buf], *vec.words(buf, offs, vec.LOWER_LUT)


def _sequences(row: np.ndarray, h: np.ndarray, size: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows in a line, each row with ``order`` - 1 starts before and a stop behind, and each row's edges."""
    n = np.bincount(row, minlength=size)
    edge = np.r_[0, np.cumsum(n + order)]
    line = np.full(edge[-1], _START)
    line[np.arange(len(h)) + order * row + order - 1] = h
    line[edge[1:] - 1] = _STOP
    return line, edge


def _grams(line: np.ndarray, edge: np.ndarray, order: int) -> list[np.ndarray]:
    """For each k up to ``order``, the hash of the k-gram that ends at each place of ``line``; those at the row's starts but
    the last stand for the history of its first token."""
    out = []
    for k in range(1, order + 1):
        g = vec.grams(line, k) ^ _SALT[k - 1]
        out.append(vec.mix(np.r_[np.zeros(k - 1, U), g])[: len(line)])
    return out


def _places(edge: np.ndarray, order: int, length: int) -> np.ndarray:
    """Which places of a line hold tokens, not starts."""
    at = np.arange(length) - np.repeat(edge[:-1], np.diff(edge))
    return at >= order - 1


# --- what the corpus is gathered into -----------------------------------------------------------------

def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c): exact counts of words and ends."""
    def count(batches):
        ends, held, size = 0, {}, 0
        for b in batches:
            ends += len(b)
            for _, _, buf, s, e, _, h in _slices(column(b, "text")):
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                for i, j, k in zip(s[first].tolist(), e[first].tolist(), n.tolist(), strict=True):
                    token = buf[i:j].tobytes()
                    held[token] = held.get(token, 0) + k
                    size += j - i
                if size >= 8 * HELD:
                    yield vec.batch_of(_TOKENS, list(held), list(held.values()))
                    held, size = {}, 0
        yield vec.batch_of(_TOKENS, [*held, END], [*held.values(), ends])

    return (docs.select("text").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))
            .filter(F.col("c") > 0))


class LogFilter:
    """Log-frequency Bloom filter of 2^``log2`` segments, each as large as its keys ask for."""

    def __init__(self, log2: int, sizes: dict[int, int], segments):
        """``sizes``: bytes of each segment; ``segments``: (segment, bits) one after another, so that few are held beside the whole."""
        self.log2 = log2
        of = np.array([sizes.get(s, 0) for s in range(1 << log2)], np.int64)
        start = np.r_[0, np.cumsum(of)]
        self.start, self.size = start[:-1].astype(U) * U(8), of.astype(U) * U(8)
        self.bits = np.zeros(start[-1], np.uint8)
        for s, bits in segments:
            self.bits[start[s]: start[s + 1]] = np.frombuffer(bits, np.uint8)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Level of each gram, 0 where it is not known."""
        level = np.zeros(len(grams), np.uint8)
        seg = (grams >> U(64 - self.log2)).astype(np.int64)
        alive = np.flatnonzero(self.size[seg] > 0)
        j = 0
        while len(alive) and j < 255:
            j += 1
            hit = np.ones(len(alive), bool)
            for bit in _bits(grams[alive], j, self.size[seg[alive]]):
                at = self.start[seg[alive]] + bit
                hit &= (self.bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            level[alive] = j
        return level


def _bits(grams: np.ndarray, level: int, size: np.ndarray | np.uint64):
    """Bits of the key (gram, level) in a segment of ``size`` bits, below 2^32."""
    for i in range(PROBES):
        x = vec.mix(grams + U((level * PROBES + i) * int(vec.BASE) & 0xFFFFFFFFFFFFFFFF))
        yield ((x >> U(32)) * size) >> U(32)


def _level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams[first], np.add.reduceat(counts, first)


def _freed(df: DataFrame, name: str) -> DataFrame:
    """A written table whose shuffles leave the disk when it is there."""
    conf = df.sparkSession.conf
    was = conf.get(_FREE, "false")
    conf.set(_FREE, "true")
    try:
        return written_table(df, name)
    finally:
        conf.set(_FREE, was)


def gram_filter(docs: DataFrame, order: int = ORDER) -> tuple[DataFrame, int]:
    """(segment, bits), written: the filter of all grams of up to ``order`` tokens; and its segments, as a power of two."""
    spark = docs.sparkSession
    log2 = max(LEAST_SEGMENTS, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def added(held):
        g, c = np.unique(np.concatenate(held), return_counts=True)
        edge = np.searchsorted(g >> U(64 - log2), np.arange((1 << log2) + 1, dtype=U))
        for s in np.flatnonzero(np.diff(edge)).tolist():
            yield vec.batch_of(_GRAMS, [s], [g[edge[s]: edge[s + 1]].tobytes()], [c[edge[s]: edge[s + 1]].astype(np.uint32).tobytes()])

    def gather(batches):
        held, size = [], 0
        for b in batches:
            for lo, hi, _, _, _, row, h in _slices(column(b, "text")):
                line, edge = _sequences(row, h, hi - lo, order)
                at = np.arange(len(line)) - np.repeat(edge[:-1], np.diff(edge))
                for k, g in enumerate(_grams(line, edge, order), 1):
                    held.append(g[at >= (order - 1 if k == order else order - 2)])        # the last start is a history too
                    size += len(held[-1])
            if size >= HELD:
                yield from added(held)
                held, size = [], 0
        if size:
            yield from added(held)

    def fill(batches):
        held, size, most = {}, 0, 4 * HELD
        for b in batches:
            for s, g, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                held.setdefault(s, []).append((np.frombuffer(g, U), np.frombuffer(c, np.uint32).astype(np.int64)))
                size += len(g) // 8
                if size > most:
                    held = {s: [_merge(x)] for s, x in held.items()}
                    size = sum(len(x[0][0]) for x in held.values())
                    most = max(most, 2 * size)
        for s in list(held):
            grams, counts = _merge(held.pop(s))
            level = _level(counts)
            bits = np.zeros(min((1 << 32) - 8, -(-int(level.sum()) * KEY_BITS // 8) * 8 + 64), bool)
            j = 1
            while len(grams):
                for at in _bits(grams, j, U(len(bits))):
                    bits[at.astype(np.int64)] = True
                more = level > j
                grams, level, j = grams[more], level[more], j + 1
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
                                             names=["segment", "bits"])

    rows = docs.select("text").mapInArrow(gather, "segment int, grams binary, counts binary")
    return _freed(rows.repartitionById(1 << log2, F.col("segment")).mapInArrow(fill, "segment int, bits binary"), "gram_filter"), log2


# --- scores ---------------------------------------------------------------------------------------------

def _scores(line: np.ndarray, edge: np.ndarray, order: int, total: int, distinct: int, levels) -> np.ndarray:
    """log10 probability of each row; ``levels`` tells the level of hashes."""
    grams = _grams(line, edge, order)
    unique, back = np.unique(np.concatenate(grams), return_inverse=True)
    level = levels(unique).astype(float)
    counts = np.where(level > 0, BASE ** (level - 1), 0.0)[back].reshape(order, len(line))
    token = np.flatnonzero(_places(edge, order, len(line)))
    p = (counts[0][token] + 1) / (total + distinct + 1)
    for k in range(1, order):
        history = counts[k - 1][token - 1]
        p = (np.minimum(counts[k][token], history) + PRIOR * p) / (history + PRIOR)
    row = np.searchsorted(edge, token, "right") - 1
    return np.bincount(row, np.log10(np.minimum(p, 1.0)), len(edge) - 1)


def _packed(lines: list[np.ndarray], edges: list[np.ndarray]) -> tuple[bytes, bytes, bytes]:
    """Distinct hashes, places among them (two bytes each, if that will do) and edges of the rows of several lines, as one line."""
    known, at = np.unique(np.concatenate(lines), return_inverse=True)
    ends = np.cumsum([len(x) for x in lines]) - [len(x) for x in lines]
    edge = np.r_[0, np.concatenate([e[1:] + n for e, n in zip(edges, ends.tolist(), strict=True)])]
    return known.tobytes(), at.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32).tobytes(), edge.astype(np.int64).tobytes()


def _unpacked(line: bytes, at: bytes, edge: bytes) -> tuple[np.ndarray, np.ndarray]:
    edge = np.frombuffer(edge, np.int64)
    return np.frombuffer(line, U)[np.frombuffer(at, np.uint16 if len(at) == 2 * edge[-1] else np.uint32)], edge


def _dealt_scores(blocks: DataFrame, bits: DataFrame, log2: int, order: int, total: int, distinct: int) -> DataFrame:
    """(row, score) with the filter left in its segments: the distinct grams of a block of texts go to the segments, a piece
    for each, and their levels come back. A block's row is that of its first text."""
    def probes(batches):
        for b in batches:
            for row, *packed in zip(*(column(b, c).to_pylist() for c in ("row", "line", "at", "edge")), strict=True):
                g = np.unique(np.concatenate(_grams(*_unpacked(*packed), order)))
                edge = np.searchsorted(g >> U(64 - log2), np.arange((1 << log2) + 1, dtype=U))
                found = np.flatnonzero(np.diff(edge)).tolist()
                yield vec.batch_of(_PROBE, found, [row] * len(found), [g[edge[s]: edge[s + 1]].tobytes() for s in found])

    def probe(batches):
        held, asked = None, []                                            # asked: (row, segment, grams) for the segment held

        def answered():
            ends = np.cumsum([len(x[2]) // 8 for x in asked]).tolist()
            level = held.levels(np.frombuffer(b"".join(x[2] for x in asked), U))
            return vec.batch_of(_LEVELS, [x[0] for x in asked], [x[1] for x in asked],
                                [level[i:j].tobytes() for i, j in zip([0, *ends], ends, strict=False)])

        for b in batches:
            for s, row, grams, own in zip(*(column(b, c).to_pylist() for c in ("segment", "row", "grams", "bits")), strict=True):
                if own is None:
                    asked.append((row, s, grams))
                    continue
                if asked:
                    yield answered()
                held, asked = LogFilter(log2, {s: len(own)}, [(s, own)]), []       # a segment's bits come before its probes
            if asked:
                yield answered()
                asked = []

    def score(batches):
        for b in batches:
            for row, *packed, met in zip(*(column(b, c).to_pylist() for c in ("row", "line", "at", "edge", "met")), strict=True):
                line, edge = _unpacked(*packed)                           # its sorted grams lie in the order of the segments
                known = np.concatenate([np.frombuffer(x["levels"], np.uint8) for x in met])
                found = _scores(line, edge, order, total, distinct, lambda _, known=known: known)
                yield vec.batch_of(pa.schema([("row", pa.int64()), ("score", pa.float64())]), pa.array(np.arange(row, row + len(found))), pa.array(found))

    none = F.lit(None)
    both = (bits.select("segment", none.cast("long").alias("row"), none.cast("binary").alias("grams"), "bits")
            .unionByName(blocks.mapInArrow(probes, "segment int, row long, grams binary").withColumn("bits", none.cast("binary"))))
    met = (both.repartitionById(1 << log2, F.col("segment")).sortWithinPartitions("segment", F.col("row").asc_nulls_first())
           .mapInArrow(probe, "row long, segment int, levels binary"))
    return (blocks.join(met.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("segment", "levels"))).alias("met")), "row")    # a block's own grams
            .mapInArrow(score, "row long, score double"))


def lm_scores(docs: DataFrame, learn, order: int = ORDER, head: int = HEAD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each document; ``learn`` is the condition of those learned from."""
    spark = docs.sparkSession
    vec.bounded_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learned = docs.filter(learn).select(F.col("text").cast("string").alias("text"))
    counts = _freed(token_counts(learned), "token_counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    common = counts.orderBy(F.desc("c"), "token").limit(head)
    top = common.collect()                                                     # head rows at most
    end = next((r.c for r in counts.filter(F.col("token") == F.lit(END)).collect()), 0)
    bits, log2 = gram_filter(learned, order)
    sizes = {r.segment: r.size for r in bits.select("segment", F.length("bits").alias("size")).collect()}      # a number a segment
    small = sum(sizes.values()) <= broadcast_bytes
    shared = spark.sparkContext.broadcast((
        {bytes(r.token): r.c for r in top}, LogFilter(log2, sizes, ((r.segment, r.bits) for r in bits.toLocalIterator())) if small else None))
    del top
    spread = np.log10(total + distinct + 1)

    def score(batches):
        number = TaskContext.get().partitionId() << 40
        known, filter_ = shared.value
        lines, edges, held, begun = [], [], 0, number                              # of the block, if the filter is dealt

        def block():
            return vec.batch_of(_ROWS, [begun + 1], *([None] for _ in range(6)), *([x] for x in _packed(lines, edges)))

        for b in batches:
            texts = column(b, "text")
            for lo, hi, buf, s, e, row, h in _slices(texts):
                size = hi - lo
                u, first, back = np.unique(h, return_index=True, return_inverse=True)
                tokens = [buf[i:j].tobytes() for i, j in zip(s[first].tolist(), e[first].tolist(), strict=True)]
                c = np.array([known.get(t, -1) for t in tokens], np.int64)[back] if len(u) else np.zeros(0, np.int64)
                n = np.bincount(row, minlength=size)
                near = c >= 0
                base = np.bincount(row[near], np.log10(c[near] + 1.0), size) + np.log10(end + 1.0) - (n + 1) * spread
                seen = np.bincount(row[near], minlength=size) + (end > 0)
                line, edge = _sequences(row, h, size, order)
                far = np.flatnonzero(~near)
                r, i, k = _tail(row[far], back[far], len(u))
                rest = pa.ListArray.from_arrays(np.searchsorted(r, np.arange(size + 1)).astype(np.int32),
                                                pa.StructArray.from_arrays([pa.array([tokens[x] for x in i.tolist()], pa.binary()), pa.array(k, pa.int64())], ["token", "k"]))
                score = _scores(line, edge, order, total, distinct, filter_.levels) if filter_ else np.full(size, np.nan)
                none = pa.nulls(size, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(size) + number + 1), column(b, "doc_id").slice(lo, size), pa.array(n + 1), pa.array(seen), pa.array(base),
                     pa.array(score), rest, none, none, none], schema=_ROWS)
                number += size
                if not filter_:
                    lines, edges, held = [*lines, line], [*edges, edge], held + len(line)
                if held >= BLOCK:
                    yield block()
                    lines, edges, held, begun = [], [], 0, number
        if held:
            yield block()

    written = written_table(plain.mapInArrow(score, "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, "
                                             "rest array<struct<token: binary, k: long>>, line binary, at binary, edge binary"), "lm_rows")
    rows = written.filter("line is null").drop("line", "at", "edge")
    rest = (rows.select("row", F.explode("rest").alias("t")).select("row", "t.token", "t.k").join(counts, "token")
            .groupBy("row").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("more")))
    if small:
        scored = rows.drop("rest")
    else:
        blocks = written.filter("line is not null").select("row", "line", "at", "edge")
        parts = [_freed(_dealt_scores(blocks.filter(F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == i), bits, log2, order, total, distinct), "lm_dealt")
                 for i in range(ROUNDS)]
        scored = rows.drop("score", "rest").join(functools.reduce(DataFrame.unionByName, parts), "row")
    return (scored.join(rest, "row", "left")
            .select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
                    (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score"))


def _tail(row: np.ndarray, token: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, token and number of each token of a row, sorted by row."""
    u, k = np.unique(row * max(tokens, 1) + token, return_counts=True)
    return u // max(tokens, 1), u % max(tokens, 1), k


def held_out(doc_id, mod: int = 7, rest: int = 2):
    """Whether the CRC-32 of the doc_id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == rest, F.lit(False))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scores = lm_scores(docs, F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
