"""Bloom filters of a fixed size, built by segments on the executors.

A hash belongs to one segment (its top bits), so each task fills whole segments and the filter is the
concatenation of the segments' rows. The size of the result is a parameter, whatever the input: a filter
that is too small for its input lets more hashes through (callers confirm exactly), it never loses one.
The filter of hashes seen once never leaves the tasks; it grows with the number of segments, which
follows the session's number of shuffle partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
LEAST_SEGMENTS = 6                   # 64 segments, as a power of two
PROBES = 3
FILTER_LOG2 = 27                     # bits of a whole filter, as a power of two: 16 MiB
ONCE_LOG2 = 24                       # bits of a segment of the filter of hashes seen once


def _positions(h: np.ndarray, log2: int) -> Iterator[np.ndarray]:
    """Bit positions in a segment of 2^log2 bits, one array per probe."""
    inner = U((1 << log2) - 1)
    step = (h >> U(17)) | U(1)
    for i in range(PROBES):
        yield ((h + U(i) * step) & inner).astype(np.int64)


class _Bits:
    """Segments of 2^log2 bits, made when they are first met."""

    def __init__(self, log2: int):
        self.log2, self.of = log2, {}

    def get(self, seg: int) -> np.ndarray:
        if seg not in self.of:
            self.of[seg] = np.zeros(1 << self.log2, bool)
        return self.of[seg]

    def add(self, seg: int, h: np.ndarray) -> None:
        bits = self.get(seg)
        for p in _positions(h, self.log2):
            bits[p] = True

    def has(self, seg: int, h: np.ndarray) -> np.ndarray:
        bits, found = self.get(seg), np.ones(len(h), bool)
        for p in _positions(h, self.log2):
            found &= bits[p]
        return found


class Bloom:
    """A filled filter; 2^log2 bits in 2^segments segments."""

    def __init__(self, bits: bytes, log2: int, segments: int):
        self.bits, self.log2, self.segments = np.frombuffer(bits, np.uint8), log2, segments

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Which hashes (uint64) it may hold."""
        inner = self.log2 - self.segments
        base = (h >> U(64 - self.segments)).astype(np.int64) << inner
        found = np.ones(len(h), bool)
        for p in _positions(h, inner):
            at = base + p
            found &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return found


def _filled(df: DataFrame, log2: int, seen_before: bool) -> Bloom:
    spark = df.sparkSession
    segments = max(LEAST_SEGMENTS, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    segments = min(segments, log2 - 10)

    def fill(batches):
        once, out = _Bits(ONCE_LOG2), _Bits(log2 - segments)
        for b in batches:
            h, counts = np.unique(b.column(0).to_numpy(zero_copy_only=False).view(U), return_counts=True)
            edge = np.searchsorted(h >> U(64 - segments), np.unique(h >> U(64 - segments))).tolist() + [len(h)]
            for i, j in zip(edge, edge[1:], strict=False):
                if i == j:
                    continue
                s, own, n = int(h[i] >> U(64 - segments)), h[i:j], counts[i:j]
                if seen_before:
                    out.add(s, own[once.has(s, own) | (n > 1)])
                    once.add(s, own)
                else:
                    out.add(s, own)
        for s, bits in out.of.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())],
                                             names=["segment", "bits"])

    h = F.col(df.columns[0])
    rows = (df.filter(h.isNotNull()).repartitionById(1 << segments, F.shiftrightunsigned(h, 64 - segments).cast("int"))
            .mapInArrow(fill, "segment int, bits binary").collect())       # the filter: a fixed size
    size = 1 << (log2 - segments - 3)
    held = {r.segment: bytes(r.bits) for r in rows}
    return Bloom(b"".join(held.get(s, bytes(size)) for s in range(1 << segments)), log2, segments)


def seen_filter(df: DataFrame, log2: int = FILTER_LOG2) -> Bloom:
    """Filter of the hashes in the only column of ``df``."""
    return _filled(df, log2, seen_before=False)


def twice_filter(df: DataFrame, log2: int = FILTER_LOG2) -> Bloom:
    """Second of two filters: each hash goes into the first, and into the second if the first had it."""
    return _filled(df, log2, seen_before=True)
