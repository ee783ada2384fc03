"""Byte-level BPE: encoding and decoding with a rank file.

A text is split by the pattern; each piece that is not a token itself goes, with the other new pieces of
its slice, into padded numpy matrices by length. In every round each row merges its leftmost pair of the
least rank: pairs are looked up in an open-addressing hash table of all pairs that join to a token, the
row is compacted, and only the two pairs beside the merge are looked up again. Finished rows leave the
matrix. A piece of over ``LONG`` bytes would need as many rounds as bytes over a matrix as wide, so it is
merged with a heap over the same pair table, in the same order. Pieces met before come from a cache of
bounded size.

Cases: null and empty texts have no tokens and decode to no bytes; every text decodes to its own UTF-8
bytes; other columns stay as they are; an empty table gives no rows."""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import vec
from shelfspark.llm.vec import batch_of, column

LONG = 256
CACHE_PIECES = 150_000
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Bytes of the tokens, by id."""

    def __init__(self, data: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        tokens = [b""] * (max(self.ids.values()) + 1)
        for t, i in self.ids.items():
            tokens[i] = t
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of runs of ``counts`` ids each."""
        size = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = self.bytes[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends[:-1], size)].tobytes()
        edge = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[i:j] for i, j in zip(edge, edge[1:], strict=False)]


class Ranks(Vocabulary):
    """The vocabulary with the hash table of pairs."""

    def __init__(self, data: bytes):
        super().__init__(data)
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for t, i in self.ids.items():
            for cut in range(1, len(t)):
                a, b = self.ids.get(t[:cut]), self.ids.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        self.log2 = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.log2, -1, np.int64)
        self.values = np.full(1 << self.log2, NONE, np.int32)
        key = np.fromiter(pairs, np.int64, len(pairs))
        value = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(key)
        while len(key):                               # all that find their slot free settle; the others go one on
            free = self.keys[slot] < 0
            first = np.zeros(len(key), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            key, value, slot = key[~put], value[~put], (slot[~put] + 1) & ((1 << self.log2) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * vec.BASE) >> np.uint64(64 - self.log2)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair joins to no token (or a or b is negative)."""
        key = (a.astype(np.int64) << 32 | b.astype(np.int64)).ravel()
        key[(a.ravel() < 0) | (b.ravel() < 0)] = -2
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.values[slot], NONE)
        todo = np.flatnonzero((held != key) & (held != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.log2) - 1)
            held = self.keys[slot[todo]]
            out[todo] = np.where(held == key[todo], self.values[slot[todo]], NONE)
            todo = todo[(held != key[todo]) & (held != -1)]
        return out.reshape(a.shape)


def _merge_rows(r: Ranks, pieces: list[bytes], width: int) -> list[bytes]:
    """Token ids (little-endian, 32 bits) of pieces of at most ``width`` bytes."""
    n = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, n)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    ids = np.full((n, width + 1), -1, "<i4")         # one column of padding at the end
    ids[np.repeat(np.arange(n), size), np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)] = r.single[raw]
    pair = r.rank(ids[:, :-1], ids[:, 1:])
    out: list[bytes] = [b""] * n
    rows = np.arange(n)
    span = np.arange(width + 1)
    while len(rows):
        at = pair.argmin(1)                            # leftmost of the least rank
        best = pair[np.arange(len(rows)), at]
        done = best == NONE
        for i in np.flatnonzero(done).tolist():
            out[rows[i]] = ids[i, : size[i]].tobytes()
        if done.any():
            live = ~done
            rows, ids, pair, size, at, best = rows[live], ids[live], pair[live], size[live], at[live], best[live]
            if not len(rows):
                break
        m = np.arange(len(rows))
        ids[m, at] = best
        shift = np.minimum(span[None, :] + (span[None, :] > at[:, None]), ids.shape[1] - 1)
        ids = np.take_along_axis(ids, shift, 1)
        ids[:, -1] = -1
        pair = np.take_along_axis(pair, np.minimum(span[None, :-1] + (span[None, :-1] > at[:, None]), pair.shape[1] - 1), 1)
        pair[:, -1] = NONE
        size -= 1
        pair[m, at] = r.rank(ids[m, at], ids[m, at + 1])
        left = np.flatnonzero(at > 0)
        pair[left, at[left] - 1] = r.rank(ids[left, at[left] - 1], ids[left, at[left]])
        most = int(size.max()) + 1                     # columns that no row needs any more
        if most < ids.shape[1] - 1:
            ids, pair, span = ids[:, :most].copy(), pair[:, : most - 1].copy(), span[:most]
    return out


def _merge_long(r: Ranks, piece: bytes) -> bytes:
    """The same merges for one long piece: a heap of (rank, place) over a linked list."""
    ids = r.single[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    get = r.pairs.get
    heap = [(k, i) for i in range(n - 1) if (k := get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        k, i = heapq.heappop(heap)
        j = right[i] if ids[i] >= 0 else n
        if j >= n or get(ids[i] << 32 | ids[j]) != k:  # one of the two has been merged meanwhile
            continue
        ids[i], ids[j] = k, -1
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
            if (x := get(k << 32 | ids[right[i]])) is not None:
                heapq.heappush(heap, (x, i))
        if left[i] >= 0 and (x := get(ids[left[i]] << 32 | k)) is not None:
            heapq.heappush(heap, (x, left[i]))
    return np.array([x for x in ids if x >= 0], "<i4").tobytes()


def merge(r: Ranks, pieces: list[bytes]) -> list[bytes]:
    """Token ids of each piece, as little-endian 32-bit integers."""
    out: list[bytes] = [b""] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if (whole := r.ids.get(p)) is not None:
            out[i] = whole.to_bytes(4, "little")
        elif len(p) > LONG:
            out[i] = _merge_long(r, p)
        else:
            by_width.setdefault(max(4, -(-len(p) // 4) * 4), []).append(i)
    for width, rows in by_width.items():
        step = max(1, 1_000_000 // width)              # cells of a matrix
        for a in range(0, len(rows), step):
            for i, ids in zip(rows[a: a + step], _merge_rows(r, [pieces[i] for i in rows[a: a + step]], width), strict=True):
                out[i] = ids
    return out


class Encoder:
    def __init__(self, data: bytes, pattern: str):
        import regex
        # \s is the Unicode property, without the separators U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.ranks = Ranks(data)
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        pieces = [self.split(t) if t else [] for t in texts]
        new: set[str] = set()
        for p in pieces:
            new.update(p)
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        todo = list(new.difference(self.cache))
        self.cache.update(zip(todo, merge(self.ranks, [p.encode() for p in todo]), strict=True))
        get = self.cache.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


_HELD: dict = {}


def _held(kind, data: Broadcast, known: str, *more):
    """One object per worker process."""
    key = (kind, known, *more)
    if key not in _HELD:
        if len(_HELD) > 4:
            _HELD.clear()
        _HELD[key] = kind(data.value, *more)
    return _HELD[key]


class Files:
    """The rank file, a vocabulary of a fixed size, sent to the executors; only the driver opens the path."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = ""):
        vec.bounded_batches(spark)
        with open(path, "rb") as f:
            data = f.read()
        self.data, self.known, self.pattern = spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest(), pattern

    def encoded(self, batches, text: str, to: str):
        """Batches with the token ids of ``text`` behind the other columns, about half a megabyte of text in each."""
        encoder = _held(Encoder, self.data, self.known, self.pattern)
        for b in batches:
            names = [c for c in b.schema.names if c != to]
            for lo, hi, _, _ in vec.slices(column(b, text)):
                part = b.slice(lo, hi - lo)
                found = encoder.encode(column(part, text).to_pylist())
                ends = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([*[column(part, c) for c in names], ids], names=[*names, to])

    def decoded(self, batches, ids: str, to: str):
        """Batches with the bytes of ``ids`` behind the other columns, about a quarter of a million ids in each."""
        vocabulary = _held(Vocabulary, self.data, self.known)
        for b in batches:
            names, at = [c for c in b.schema.names if c != to], 0
            counts = np.asarray(column(b, ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            while at < len(b):
                end = max(at + 1, at + int(np.searchsorted(np.cumsum(counts[at:]), 250_000, "right")))
                part = b.slice(at, end - at)
                out = vocabulary.decode(column(part, ids).flatten().to_numpy(zero_copy_only=False), counts[at:end])
                yield pa.RecordBatch.from_arrays([*[column(part, c) for c in names], pa.array(out, pa.binary())], names=[*names, to])
                at = end


def _with(docs: DataFrame, to: str, kind: str):
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != to], F.lit(None).cast(kind).alias(to)).schema


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in ``to`` (array of int, in place of a column so named)."""
    files = Files(docs.sparkSession, ranks_path, pattern)
    return docs.mapInArrow(lambda batches: files.encoded(batches, text, to), _with(docs, to, "array<int>"))


def decode(docs: DataFrame, ranks_path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of the token ids in ``to`` (binary). Null ids decode to no bytes."""
    files = Files(docs.sparkSession, ranks_path)
    return docs.mapInArrow(lambda batches: files.decoded(batches, ids, to), _with(docs, to, "binary"))


def encode_checked(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, and round_trip: whether the ids decode to the text's bytes. One pass of one worker."""
    files = Files(docs.sparkSession, ranks_path, pattern)

    def run(batches):
        for b in files.decoded(files.encoded(batches, "text", "token_ids"), "token_ids", "decoded"):
            ids = column(b, "token_ids")
            same = [x == (t or "").encode() for x, t in zip(column(b, "decoded").to_pylist(), column(b, "text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), ids, ids.value_lengths().cast(pa.int64()), pa.array(same, pa.bool_())],
                                             names=["doc_id", "token_ids", "n_tokens", "round_trip"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens long, round_trip boolean"))


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digest(batches):
    for b in batches:
        ids = column(b, "token_ids")
        raw = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        edge = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
        yield batch_of(_DIGEST, column(b, "doc_id"), np.diff(edge), [hashlib.sha256(raw[4 * i: 4 * j]).hexdigest() for i, j in zip(edge, edge[1:], strict=False)],
                       [hashlib.sha256(x).hexdigest() for x in column(b, "decoded").to_pylist()])


def tokens_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the encoded and decoded texts, in one pass of one worker."""
    files = Files(docs.sparkSession, ranks_path, pattern)
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(lambda batches: _digest(files.decoded(files.encoded(batches, "text", "token_ids"), "token_ids", "decoded")),
                        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tokens_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
