"""N-gram Jaccard self-join by chosen paths.

Texts with equal sets of five-word shingles form one class, represented by its least doc_id. A
representative has ``TOKENS`` min-hashes as the tokens of its set.

1. Runs. Each of ``RUNS`` runs starts a path: sets that share the run's token fall into one bucket. At
   similarity 0.8 a pair misses all ten with probability 0.2^10.
2. Buckets of at most ``SMALL`` sets are compared by brute force on their tokens; pairs that agree well
   enough to be similar with any likelihood are joined as a spanning forest, not as pairs.
3. A larger bucket first meets ``PIVOTS`` of its own sets. A set that is close to a pivot leaves the
   bucket: whatever is similar to it is joined to that pivot too, by the triangle inequality of the
   Jaccard distance. The others go down ``CHILDREN`` paths, on tokens that the path's hash chooses.
   After ``DEPTH`` levels what is left is compared exactly, by pairs of blocks.
4. The joined sets form coarse groups. Within a group the full shingle sets are compared exactly, by
   pairs of blocks; links are counted where they are found and go on as a spanning forest. Its
   components are the classes of the result.

No step makes the pairs of a group as rows. Cases: shingles are of words between blanks, A-Z
lower-cased; a text of one to four words is one shingle; a text without words (null, empty, blank) is
its own class without links; rows without a doc_id have a null class and no links; rows that share a
doc_id are one document; repeated rows count as copies; an empty table gives no rows; other columns are
not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import vec
from shelfspark.llm.bloom import FILTER_LOG2, seen_filter
from shelfspark.llm.components import compact, components
from shelfspark.llm.vec import batch_of, column
from shelfspark.session import cut_lineage

U = np.uint64
WORDS, LEAST = 5, 0.8
TOKENS, RUNS, CHILDREN, DEPTH = 64, 10, 2, 6
SMALL, PIVOTS, PART, BLOCK = 512, 32, 2048, 256
MAYBE = 0.55          # agreement of tokens from which on a pair goes to the exact comparison (five standard errors under 0.8)
CORE, NEAR = 0.65, 0.35   # agreement with a pivot: to leave the bucket; to be joined to the pivot
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)
_SALT = _rng.integers(0, 1 << 63, CHILDREN, dtype=np.uint64)
_SETS = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary())])
_MEMBERS = pa.schema([("key", pa.int64()), ("id", pa.int64())])
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_FULL = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def _shingles(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct shingles, sorted by both."""
    _, _, row, h = vec.words(buf, offs, vec.LOWER_LUT)
    g = vec.grams(h, words)
    same = row[: len(g)] == row[words - 1:] if len(g) else np.zeros(0, bool)
    count = np.bincount(row, minlength=len(offs) - 1)
    few = np.flatnonzero((count > 0) & (count < words))                       # all words as one shingle
    start = np.searchsorted(row, few)
    short = np.array([vec.grams(h[i: i + n], n)[0] for i, n in zip(start.tolist(), count[few].tolist(), strict=True)], U)
    r, g = np.concatenate([row[: len(g)][same], few]), np.concatenate([g[same], short])
    order = np.lexsort((g, r))
    r, g = r[order], g[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (r[1:] != r[:-1])] if len(g) else np.zeros(0, bool)
    return r[new], g[new]


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, k1, k2, sig): digest of the shingle set, and its tokens; texts without words are left out."""
    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in vec.slices(column(b, "text")):
                r, g = _shingles(buf, offs, words)
                if not len(r):
                    continue
                start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                sig = np.stack([np.minimum.reduceat(g * a + c, start) for a, c in zip(_A, _B, strict=True)], 1)
                k1, k2 = np.add.reduceat(vec.mix(g), start), np.add.reduceat(vec.mix(g * vec.BASE2 + U(1)), start)
                yield batch_of(_SETS, column(b, "doc_id").slice(lo, hi - lo).take(pa.array(r[start])), vec.signed(k1), vec.signed(k2), [x.tobytes() for x in sig])

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, sig binary")


def _forest(ids: np.ndarray, close: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning forest (each id to its component's least) of a symmetric relation."""
    m = len(ids)
    label = np.arange(m)
    order = np.argsort(ids, kind="stable")
    close = close[np.ix_(order, order)] | np.eye(m, dtype=bool)
    while True:
        new = np.where(close, label[None, :], m).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    ids = ids[order]
    far = np.flatnonzero(label != np.arange(m))
    return ids[far].tolist(), ids[label[far]].tolist()


def _tokens(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), U).reshape(-1, TOKENS)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal tokens of each row of a with each of b."""
    out = np.zeros((len(a), len(b)), np.int32)
    for t in range(TOKENS):
        out += a[:, t, None] == b[None, :, t]
    return out / TOKENS


def _compare_small(batches):
    for g in vec.groups(batches, 1):
        ids = g.column("id").to_numpy()
        if len(ids) > 1:
            s = _tokens(g.column("sig").to_pylist())
            yield batch_of(_EDGES, *_forest(ids, _agree(s, s) >= MAYBE))


def _path(key: np.ndarray, n: int) -> np.ndarray:
    """The token that child ``n`` of each bucket looks at."""
    return (vec.mix(key.view(U) + _SALT[n]) % U(TOKENS)).astype(np.int64)


def _child(key: np.ndarray, n: int, token: np.ndarray) -> np.ndarray:
    return vec.signed(vec.mix(vec.mix(key.view(U) ^ _SALT[n]) + token))


def _roots(batches):
    for b in batches:
        s = _tokens(column(b, "sig").to_pylist()) if len(b) else np.zeros((0, TOKENS), U)
        ids = column(b, "id").to_numpy(zero_copy_only=False)
        for r in range(RUNS):
            yield batch_of(_MEMBERS, _child(np.full(len(ids), r, np.int64), 0, s[:, r]), ids)


def _against_pivots(batches):
    """Parts of buckets, pivots first: edges (u, v), and the children (key, u) of the members that stay."""
    for g in vec.groups(batches, 2):
        key = g.column("key").to_numpy()[:1]
        kind, ids = g.column("member").to_numpy(), g.column("id").to_numpy()
        sig = _tokens(g.column("sig").to_pylist())
        n = int((kind == 0).sum())
        pivot, ids, sig, tokens = ids[:n], ids[n:], sig[n:], sig[:n]
        near = _agree(sig, tokens)
        first = np.where((near >= NEAR).any(1), (near >= NEAR).argmax(1), -1)
        joined = np.flatnonzero(first >= 0)
        u, v = ids[joined], pivot[first[joined]]
        # pivots that are near the same member are joined to each other once, not by every member
        p, q = np.unique(np.stack([first[joined].repeat(n), np.tile(np.arange(n), len(joined))])[:, (near[joined] >= NEAR).ravel()], axis=1)
        u, v = np.concatenate([u, pivot[p]]), np.concatenate([v, pivot[q]])
        yield batch_of(_LEVEL, u, v, pa.nulls(len(u), pa.int64()))
        left = np.flatnonzero(near.max(1) < CORE)
        for c in range(CHILDREN):
            child = _child(np.repeat(key, len(left)), c, sig[left, _path(key, c)[0]])
            yield batch_of(_LEVEL, ids[left], pa.nulls(len(left), pa.int64()), child)


_LEVEL = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64())])


def _blocks(members: DataFrame, sizes: DataFrame, key: str, block: int) -> DataFrame:
    """Each member once for every pair of blocks that its own block is in; a group of up to ``block`` is one block."""
    n = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), n).cast("int")
    pair = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    return (members.join(sizes, key).withColumn("own", own).withColumn("pair", F.explode(pair))
            .withColumn("cell", F.xxhash64(key, "pair.i", "pair.j")).withColumn("one", F.col("pair.i") == F.col("pair.j")))


def _compare_cells(batches):
    for g in vec.groups(batches, 1):
        ids, own = g.column("id").to_numpy(), g.column("own").to_numpy()
        s = _tokens(g.column("sig").to_pylist())
        yield batch_of(_EDGES, *_forest(ids, _agree(s, s) >= MAYBE))


def coarse_edges(reps: DataFrame) -> DataFrame:
    """Edges (u, v) that join every likely similar pair of ``reps`` (id, sig), directly or by others."""
    level, found, sigs, n = cut_lineage(reps.mapInArrow(_roots, "key long, id long")), None, None, None
    for depth in range(DEPTH + 1):
        sizes, _ = compact(level.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), n)
        level, n = compact(level.join(sizes, "key"), n)
        if sigs is None:                                       # tokens of the sets that share a bucket with another at all
            sigs, _ = compact(reps.join(level.select("id").distinct(), "id", "left_semi"))
        small = (level.filter(F.col("size") <= SMALL).join(sigs, "id").select("key", "id", "sig")
                 .repartition("key").sortWithinPartitions("key").mapInArrow(_compare_small, "u long, v long"))
        found = small if found is None else found.unionByName(small)
        big = level.filter(F.col("size") > SMALL)
        if big.isEmpty():
            break
        if depth == DEPTH:
            cells = _blocks(big.select("key", "id").join(sigs, "id"), sizes, "key", SMALL).select("cell", "id", "own", "sig")
            found = found.unionByName(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare_cells, "u long, v long"))
            break
        big = big.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / PART)))
        # pivots: of each of PIVOTS slots by hash the least id, so that partial aggregation leaves a row a slot and task
        pivots = (big.groupBy("key", "size", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("slot")).agg(F.min("id").alias("id"))
                  .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / PART) - 1))))
        rows = (big.select("key", "part", F.lit(1).alias("member"), "id").unionByName(pivots.select("key", "part", F.lit(0).alias("member"), "id"))
                .join(sigs, "id").select("key", "part", "member", "id", "sig"))
        step, _ = compact(rows.repartition("key", "part").sortWithinPartitions("key", "part", "member")
                          .mapInArrow(_against_pivots, "u long, v long, key long"))
        found = found.unionByName(step.filter("key IS NULL").select("u", "v"))
        level, n = step.filter("key IS NOT NULL").select("key", F.col("u").alias("id")), CHILDREN * n
    return found


def _full_sets(docs: DataFrame, ids: DataFrame, words: int, log2: int) -> DataFrame:
    """(id, shingles) of the documents whose id the filter of ``ids`` may hold; the text itself is not shuffled."""
    wanted = docs.sparkSession.sparkContext.broadcast(seen_filter(ids.select(F.xxhash64("id").alias("h")), log2))

    def run(batches):
        for b in batches:
            maybe = wanted.value.holds(column(b, "h").to_numpy(zero_copy_only=False).view(U))
            part = pa.RecordBatch.from_arrays([column(b, c).filter(pa.array(maybe)) for c in ("doc_id", "text")], names=["doc_id", "text"])
            for lo, hi, buf, offs in vec.slices(column(part, "text")):
                r, g = _shingles(buf, offs, words)
                start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
                raw, edge = g.tobytes(), [*(8 * start).tolist(), 8 * len(g)]
                yield batch_of(_FULL, column(part, "doc_id").slice(lo, hi - lo).take(pa.array(r[start])), [raw[i:j] for i, j in zip(edge, edge[1:], strict=False)])

    return docs.withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, "id long, shingles binary")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every two sets."""
    m = len(sets)
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((m, m))
    np.fill_diagonal(out, [len(s) for s in sets])
    keep = count[token] > 1                                                  # a token of one set has no part in any pair
    of, (_, token) = of[keep], np.unique(token[keep], return_inverse=True)
    width = max(256, 4_000_000 // max(m, 1))                                   # cells of a matrix at a time
    order = np.argsort(token, kind="stable")
    of, token = of[order], token[order]
    total = int(token[-1]) + 1 if len(token) else 0
    np.fill_diagonal(out, 0)
    for a in range(0, total, width):
        i, j = np.searchsorted(token, (a, a + width))
        has = np.zeros((m, min(width, total - a)), np.float32)
        has[of[i:j], token[i:j] - a] = 1
        out += has @ has.T
    return out


def _link_cells(batches, least: float):
    """Exact links inside each cell: a spanning forest (u, v), and each set's number of linked documents (v null)."""
    for g in vec.groups(batches, 1):
        ids, own, copies, one = (g.column(c).to_numpy() for c in ("id", "own", "copies", "one"))
        sets = [np.frombuffer(x, U) for x in g.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        common = _common(sets)
        linked = common / np.maximum(size[:, None] + size[None] - common, 1) >= least
        np.fill_diagonal(linked, False)
        if not one[0]:
            linked &= own[:, None] != own[None]                                # pairs inside a block belong to the block's own cell
        n = (linked * copies[None]).sum(1)
        u, v = _forest(ids, linked)
        some = np.flatnonzero(n)
        yield batch_of(_LINKS, u, v, [0] * len(u))
        yield batch_of(_LINKS, ids[some], pa.nulls(len(some), pa.int64()), n[some].astype(np.int64))


def near_duplicates(docs: DataFrame, words: int = WORDS, least: float = LEAST, log2: int = FILTER_LOG2) -> DataFrame:
    """(doc_id, class_id, n_links) of each row: the least doc_id of its connected class, and the number of other
    documents at similarity ``least`` or more (copies among them)."""
    vec.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.filter(F.col("doc_id").isNotNull())
    sets = cut_lineage(signatures(known, words))
    reps = cut_lineage(sets.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("sig").alias("sig")))
    groups = components(coarse_edges(reps.select("id", "sig")))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    full = _full_sets(known, groups, words, log2)
    # one row a representative: a copy under another doc_id is not in ``groups``
    members = cut_lineage(full.join(groups, "id").join(reps.select("id", "copies"), "id").dropDuplicates(["id"]))
    cells = _blocks(members, sizes, "root", BLOCK).select("cell", "id", "own", "copies", "one", "shingles")
    links, _ = compact(cells.repartition("cell").sortWithinPartitions("cell")
                    .mapInArrow(lambda batches: _link_cells(batches, least), "u long, v long, n long"))
    counted = links.filter("v IS NULL").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n"))
    classes = components(links.filter("v IS NOT NULL").select("u", "v"))
    of_rep = cut_lineage(reps.select("k1", "k2", "id", "copies").join(counted, "id", "left").join(classes, "id", "left")
                         .select("k1", "k2", F.coalesce("root", "id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    judged = sets.select("doc_id", "k1", "k2").join(of_rep, ["k1", "k2"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    return (docs.select("doc_id").join(judged, "doc_id", "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
