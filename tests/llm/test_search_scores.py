import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from corpus_fixtures import SCHEMA, clash, edge_rows, edges, empty, shipped  # noqa: F401
from pyspark.sql import functions as F

from shelfspark.llm import divergence, lexical_search, lm_score

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def lowered(text):
    return (text or "").translate(UPPER)


# --- op11 ---------------------------------------------------------------------------------------

def brute_divergence(rows, min_docs, top):
    term = re.compile(divergence.TERM)
    df, occ, groups = Counter(), Counter(), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = term.findall(lowered(text))
        occ.update((lang, source, t) for t in found)
        df.update((lang, t) for t in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= min_docs)
        sources = [s for x, s in groups if x == lang]

        def p(count, total, v=len(kept)):
            return 1 + 10**9 * (count + 2) // (total + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        sizes = {s: sum(occ[lang, s, t] for t in kept) for s in sources}
        q = {t: p(sum(occ[lang, s, t] for s in sources), sum(sizes.values())) for t in kept}
        for s in sources:
            pair = sorted((-sum(f(p(occ[lang, s, t], sizes[s]), p(occ[lang, o, t], sizes[o])) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pair)]
            own = sorted((-f(p(occ[lang, s, t], sizes[s]), q[t]), t.encode(), t) for t in kept
                         if occ[lang, s, t] and p(occ[lang, s, t], sizes[s]) > q[t])[:top]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(own)]
    return sorted(out)


def many_variants():
    """Terms whose documents are spread over chunk variants and sources, around the limit."""
    rows = edge_rows()
    marks = ["", ",", ".", "!", "(", "1"]
    for n in range(8, 13):
        for i in range(n):
            rows.append((1000 + 20 * n + i, f"limit{'x' * n}{marks[i % 6]} Limit{'x' * n}{marks[(i + 1) % 6]} twice-twice", "en", f"v{i % 3}", 1))
    rows += [(2000 + i, "ÄäÀ x", "zz", f"s{i % 2}", 1) for i in range(12)] + [(3000, "", "zz", "without", 0), (3001, "alone", None, None, 0)]
    return rows


@pytest.mark.parametrize("min_docs", [10, 3, 1])
def test_divergence_equals_brute_force(spark, min_docs, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 40)                     # counts are passed on in many parts, of several batches each
    monkeypatch.setattr(divergence, "ROWS_OUT", 7)
    rows = many_variants()
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(5), min_docs, 4)
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(rows, min_docs, 4)


def test_divergence_clashing_names_and_empty(spark, edges, clash, empty):
    more = clash.select("*", *[F.lit("x").alias(c) for c in ("chunk", "term", "n", "rows", "docs", "c", "p", "p0")])
    assert sorted(divergence.divergence(more).collect()) == sorted(divergence.divergence(edges).collect())
    assert divergence.divergence(empty).collect() == []


def test_divergence_adds_up_spellings_in_their_segment(spark):
    """A term's plain spellings come out as one row a source and one of bounds, not as rows of each chunk."""
    rows = [(i, t, "en", f"s{i % 2}", 1) for i, t in enumerate(["Same same, x-y", "(same)", "SAME. same; same", "1 2", "same"])]
    counts = divergence.term_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), 10).filter("term = 'same'")
    assert sorted(counts.filter("source IS NOT NULL").select("source", "n").collect()) == [("s0", 6), ("s1", 1)]
    bounds = counts.filter("source IS NULL").collect()
    assert [(b.n, b.most, len(set(b.rows))) for b in bounds] == [(4, 7, 4)]


def test_divergence_large_counts_are_exact(spark):
    row = spark.createDataFrame([(90_000_000_000, 1_000_000_000_000, 7)], "c long, n long, v long").select(divergence._p("c", "n", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * 90_000_000_002 // (1_000_000_000_000 + 14)


# --- op12 ---------------------------------------------------------------------------------------

def brute_search(docs, items, top):
    terms = [(d, Counter(ALNUM.findall(lowered(t)))) for d, t in docs]
    n = sum(1 for _, c in terms if c)
    total = sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in terms:
            m = 25 + 75 * sum(c.values()) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ALNUM.findall(lowered(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


ITEMS = [(1, "p1 p2 p3 P4 same TEXT"), (2, None), (3, ""), (4, "n1 n2 n3 n4 n5 n6 copy text documents"), (5, "w1 w1 w1 w2"), (5, "w3 w4 text"),
         (None, "日本語 テキスト text"), (6, "nothinghere"), (7, " ".join(f"p{i}" for i in range(40)) * 30), (8, "!!! ??")]


@pytest.mark.parametrize("block,rows", [(1 << 14, 512), (8, 3)])
def test_search_equals_brute_force(spark, edges, monkeypatch, block, rows):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)      # one block, or one for nearly every item
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical_search.search(edges, items, rows=rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search([(r[0], r[1]) for r in edge_rows()], ITEMS, 10)


def test_search_collisions_do_not_change_results(spark, edges):
    """With four coordinates every bound is far too high; results stay."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical_search.search(edges, items, 3, coords=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search([(r[0], r[1]) for r in edge_rows()], ITEMS, 3)


def test_search_rescores_few(spark):
    """Bounds descend: most documents are never rescored."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, 60) if x < 50_000) for _ in range(600)]
    block = lexical_search.Block([(0, np.unique(lexical_search.vec.words(np.frombuffer(texts[5].encode(), np.uint8), np.array([0, len(texts[5].encode())]), lexical_search.vec.ALNUM_LUT)[3]))])
    batch = lexical_search.pa.RecordBatch.from_arrays([lexical_search.pa.array(range(600)), lexical_search.pa.array(texts)], names=["doc_id", "text"])
    slices = list(lexical_search._slices([batch]))
    df = Counter(int(h) for _, size, row, hh in slices for r in range(size) for h in np.unique(hh[row == r]).view(np.int64))
    block.weigh(600, sum(len(h) for *_, h in slices), df)
    best = lexical_search._Best(1, 10)
    rescored = sum(lexical_search._search(block, best, *s) for s in slices)
    assert 10 <= rescored <= 200 and best.held[0][0][0] == 5


def test_search_clashing_names_and_empty(spark, edges, clash, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    more = items.select("*", F.lit(1).alias("doc_id"), F.lit(2).alias("score"), F.lit(3).alias("item"), F.lit(4).alias("rank"))
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)      # noqa: E731
    assert key(lexical_search.search(clash, more)) == key(lexical_search.search(edges, items))
    assert lexical_search.search(empty, items).collect() == []
    assert lexical_search.search(edges, items.limit(0)).collect() == []


# --- op13 ---------------------------------------------------------------------------------------

def out_of_training(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute_base(rows):
    tokens = [(d, [*WORD.findall(lowered(t)), None]) for d, t, *_ in rows]
    c = Counter(t for d, ts in tokens if d is not None and not out_of_training(d) for t in ts)
    n, v = sum(c.values()), len(c)
    return sorted(((d, len(ts), sum(t in c for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 5)) for d, ts in tokens), key=repr)


def learn():
    return F.col("doc_id").isNotNull() & ~lm_score.held_out("doc_id")


def bases(df):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in df.collect()), key=repr)


def by_score(df):
    return sorted(((r.doc_id, r.n_tokens, round(r.score, 7)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("head", [1 << 16, 5, 1])
def test_lm_base_equals_brute_force(spark, edges, head):
    assert bases(lm_score.lm_scores(edges, learn(), head=head)) == brute_base(edge_rows())


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_dealt_filter_gives_the_same_scores(spark, edges, order):
    whole = lm_score.lm_scores(edges, learn(), order=order)
    dealt = lm_score.lm_scores(edges, learn(), order=order, broadcast_bytes=0)
    assert by_score(whole) == by_score(dealt) and bases(whole) == bases(dealt)


@pytest.mark.parametrize(("block", "blocks"), [(1, 3), (1 << 18, 1)])
def test_lm_dealt_filter_is_asked_by_blocks_of_texts(spark, monkeypatch, block, blocks):
    """Grams go to the segments once a block, not once a text, and a block's scores are those of its texts."""
    docs = spark.range(2500).selectExpr("id AS doc_id", "concat('a', id % 7, ' b', id % 11, ' c', id, ' a', id % 5) AS text").coalesce(1)
    whole, seen, dealt = lm_score.lm_scores(docs, learn()), [], lm_score._dealt_scores
    monkeypatch.setattr(lm_score, "BLOCK", block)
    monkeypatch.setattr(lm_score, "_dealt_scores", lambda rows, *rest: seen.append(rows.count()) or dealt(rows, *rest))
    assert by_score(lm_score.lm_scores(docs, learn(), broadcast_bytes=0)) == by_score(whole)
    assert sum(seen) == blocks                                            # a batch of 1000 texts is the least


def exact_scores(rows, order):
    """The same formula on quantised exact counts."""
    seqs = [(d, ["<s>"] * (order - 1) + [*WORD.findall(lowered(t)), None]) for d, t, *_ in rows]
    c, uni = Counter(), Counter()
    for d, s in seqs:
        if d is None or out_of_training(d):
            continue
        for k in range(1, order + 1):
            c.update(tuple(s[i - k + 1: i + 1]) for i in range(order - 1 if k == order else order - 2, len(s)))
        uni.update(s[order - 1:])
    n, v = sum(uni.values()), len(uni)

    def q(g):
        return lm_score.BASE ** math.floor(math.log(c[g]) / math.log(lm_score.BASE) + 1e-9) if c[g] else 0.0

    out = []
    for d, s in seqs:
        total = 0.0
        for i in range(order - 1, len(s)):
            p = (q((s[i],)) + 1) / (n + v + 1)
            for k in range(2, order + 1):
                h = q(tuple(s[i - k + 1: i]))
                p = (min(q(tuple(s[i - k + 1: i + 1])), h) + lm_score.PRIOR * p) / (h + lm_score.PRIOR)
            total += math.log10(min(p, 1.0))
        out.append((d, total / (len(s) - order + 1)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_follow_exact_counts(spark, edges, order, monkeypatch):
    """With a filter so large that probes hardly err, scores are those of quantised counts."""
    monkeypatch.setattr(lm_score, "KEY_BITS", 400)
    got = sorted(((r.doc_id, round(r.score / r.n_tokens, 3)) for r in lm_score.lm_scores(edges, learn(), order=order).collect()), key=repr)
    want = sorted(((d, round(x, 3)) for d, x in exact_scores(edge_rows(), order)), key=repr)
    assert [d for d, _ in got] == [d for d, _ in want]
    near = [abs(a - b) < 0.02 for (_, a), (_, b) in zip(got, want, strict=True)]
    assert np.mean(near) > 0.95


def test_log_filter_never_reads_too_low(spark):
    words = [f"a{i % 50} b{i % 7}" for i in range(400)]
    df = spark.createDataFrame([(w,) for w in words], "text string")
    bits, log2 = lm_score.gram_filter(df, 2)
    held = lm_score.LogFilter(log2, {r.segment: len(r.bits) for r in bits.collect()}, [(r.segment, r.bits) for r in bits.collect()])
    c = defaultdict(int)
    for w in words:
        line = lm_score.vec.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), lm_score.vec.LOWER_LUT)[3]
        seq, edge = lm_score._sequences(np.zeros(2, int), line, 1, 2)
        one, two = lm_score._grams(seq, edge, 2)
        for g in [*one.tolist(), *two[1:].tolist()]:
            c[g] += 1
    grams = np.array(list(c), np.uint64)
    level, want = held.levels(grams), lm_score._level(np.array(list(c.values())))
    assert (level >= want).all() and np.mean(level == want) > 0.9
    unknown = lm_score.vec.mix(np.arange(10_000, dtype=np.uint64) + np.uint64(1 << 40))
    assert np.mean(held.levels(unknown) > 0) < 0.05


def test_lm_clashing_names_empty_and_nothing_learned(spark, edges, clash, empty):
    more = clash.select("*", *[F.lit("x").alias(c) for c in ("c", "token", "rest", "line", "segment", "bits")])
    assert by_score(lm_score.lm_scores(more, learn())) == by_score(lm_score.lm_scores(edges, learn()))
    assert lm_score.lm_scores(empty, learn()).collect() == []
    for r in lm_score.lm_scores(edges, F.lit(False)).collect():
        assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_lm_prefers_held_out_order_over_shuffled(spark):
    """Texts of phrases (each word is followed by one of three): held-out texts score far above their shuffled words, and
    above the unigram base. (The words of the sf tables are drawn at random, order tells little there.)"""
    rng = np.random.default_rng(4)
    after = rng.integers(0, 200, (200, 3))

    def phrase():
        w = [int(rng.integers(200))]
        while len(w) < 60:
            w.append(int(after[w[-1], rng.integers(3)]))
        return w

    rows = []
    for i in range(400):
        w = phrase()
        rows += [(i, " ".join(f"x{x}" for x in w))] + [(i + 10**9, " ".join(f"x{x}" for x in rng.permutation(w)))] * out_of_training(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r.doc_id: r for r in lm_score.lm_scores(docs, ~lm_score.held_out("doc_id") & (F.col("doc_id") < 10**9)).collect()}
    pairs = [(scores[d], scores[d + 10**9]) for d in scores if d + 10**9 in scores]
    assert len(pairs) > 30
    assert all(a.score > b.score + 20 and a.score > a.base_score + 20 for a, b in pairs)


def test_registered_query_against_sql(spark):
    """op13's base columns against DuckDB at sf0.001."""
    sf = "/root/testdata/sf0.001"
    got = lm_score.op13_lm_score(spark, sf)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert bases(got) == brute_base(rows)
    assert {r.doc_id: r.held_out for r in got.collect()} == {d: out_of_training(d) for d, _ in rows}
