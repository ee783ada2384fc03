"""Whole-column text work in numpy: words of an Arrow text column and their 64-bit hashes.

Texts stay in the Arrow buffer they came in; a word is found by byte class and hashed from prefix
sums of a polynomial over its bytes, so no Python object is made per word. Memory is bounded: texts
go through in slices, and a long text in chunks cut at separators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE2 = U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(int(BASE), -1, 1 << 64))
SLICE_BYTES = 1 << 19
CHUNK_BYTES = 1 << 19

#: Byte -> byte as words see it; 32 separates words.
SPACE_LUT = np.arange(256, dtype=np.uint8)
SPACE_LUT[9:14] = 32
LOWER_LUT = SPACE_LUT.copy()
LOWER_LUT[65:91] += 32
#: Lower case; everything in ASCII but letters and digits separates.
ALNUM_LUT = LOWER_LUT.copy()
ALNUM_LUT[[b for b in range(128) if not chr(b).isalnum()]] = 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = np.full(1 << max(16, (n - 1).bit_length()), base, U)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if len(held) <= 4 * CHUNK_BYTES:
            _POWERS[int(base)] = held
    return held[:n]


def bounded_batches(spark) -> None:
    """Arrow batches of so few rows and bytes that a task holds little beside the slice it works on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    i = batch.schema.get_field_index(name)
    return batch.column(i)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a text column; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[: offs[-1]], offs


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``most`` bytes."""
    if not len(texts):
        return
    buf, offs = text_buffer(texts)
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, buf[offs[lo]: offs[hi]], offs[lo: hi + 1] - offs[lo]
        lo = hi


def _chunk(buf: np.ndarray, edges: np.ndarray, lut: np.ndarray):
    n = len(buf)
    norm = lut[buf]
    word = norm != 32
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = edges[(edges > 0) & (edges < n)]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    prefix = np.zeros(n + 1, U)
    np.cumsum((norm.astype(U) + U(1)) * _powers(n, BASE), out=prefix[1:])
    return s, e, mix((prefix[e] - prefix[s]) * _powers(n + 1, _INVERSE)[s] + (e - s).astype(U))


def words(buf: np.ndarray, offs: np.ndarray, lut: np.ndarray = SPACE_LUT):
    """Starts, ends, row and hash of every word; words end at separators and at row ends."""
    n, at, parts = len(buf), 0, []
    while at < n:
        end = min(n, at + CHUNK_BYTES)
        while end < n:                       # cut behind a separator; a longer word lengthens the chunk
            gap = np.flatnonzero(lut[buf[at:end]] == 32)
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end = min(n, 2 * end - at)
        lo, hi = np.searchsorted(offs, (at, end), "left")
        s, e, h = _chunk(buf[at:end], offs[lo:hi] - at, lut)
        parts.append((s + at, e + at, h))
        at = end
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U)
    s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return s, e, np.searchsorted(offs, s, "right") - 1, h


def grams(h: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of every run of k word hashes (rows not regarded)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out *= base
        out += h[j: j + n]
    return mix(out)


def rolling_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every w neighbours."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span:]) if w > span else x


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)


def groups(batches, keys: int) -> Iterator[pa.Table]:
    """Rows that agree in the first ``keys`` columns, of batches sorted by them, one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(len(b), bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        start = np.flatnonzero(new).tolist()
        edges = [0, *start, len(b)]
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
