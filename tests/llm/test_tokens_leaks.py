import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from shelfspark.llm import bpe, decontam
from tests.llm.corpus_fixtures import clash, edge_rows, edges, empty, shipped  # noqa: F401  fixtures
from tests.llm.test_dedup import brute_lines, brute_near

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return bpe.Encoder(f.read(), PATTERN)


def test_encoder_equals_tiktoken(reference, encoder):
    rnd = random.Random(3)
    char = lambda: chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, 0x2FF), rnd.randrange(0x4E00, 0x4F00), rnd.randrange(0x1F300, 0x1F600), 9, 10, 0x1C, 0x85, 0x2028, 0xA0]))
    texts = ["", " ", "\x1c\x1d a\x1fb", "a" * 3000, "ab" * 700, "aab" * 100, "\n" * 400, "it's we'LL  \n\n\t x", "²① 12٣", "日本語" * 100, "<|endoftext|>",
             "".join(rnd.choice("abeint") for _ in range(4000)), *["".join(char() for _ in range(rnd.randrange(300))) for _ in range(300)]]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert encoder.encode([None]) == [b""]


def test_rows_and_heap_agree(encoder):
    rnd = random.Random(4)
    pieces = ["".join(rnd.choice("abcdeéx ") for _ in range(rnd.randrange(2, 120))).encode() for _ in range(300)]
    assert [bpe._merge_long(encoder.ranks, p) for p in pieces] == [bpe._merge_rows(encoder.ranks, [p], len(p))[0] for p in pieces]


def test_query_equals_tiktoken(spark, reference):
    got = {r.doc_id: r for r in bpe.op8_byte_bpe(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = reference.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_round_trip_and_other_columns(spark, clash, empty):
    got = bpe.decode(bpe.encode(clash, RANKS, PATTERN), RANKS)
    assert got.columns == [c for c in clash.columns if c != "token_ids"] + ["token_ids", "decoded"] and got.count() == clash.count()
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.key == 0 for r in got.collect())
    assert bpe.tokens_digest(empty, RANKS, PATTERN).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>"), RANKS).first().decoded == b""


# ---- benchmark leaks ---------------------------------------------------------------------------

def test_wand_equals_exhaustive_scoring():
    rnd = random.Random(8)
    vocab = [f"t{i}" for i in range(60)]
    index = decontam.Index([(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(5, 30))), "") for i in range(100)])
    for _ in range(150):
        terms = sorted(rnd.sample(range(len(index.terms)), 25))
        scores = np.zeros(len(index.item_of))
        for t in terms:
            for unit, w in zip(*index.postings[t], strict=True):
                scores[unit] += w
        for least in (0.4, 0.6, 0.8):
            want = set(np.flatnonzero(scores >= least).tolist())
            assert {u for u, _ in index.wand(terms, index.bounds(np.array(terms), np.zeros(25, np.int64), 1)[0], least)} == want


def test_planted_items_are_found(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7)))              # noqa: E731
    text = lambda n: " ".join(word() for _ in range(n))                                           # noqa: E731
    items = [(i, f"{text(n)}?\n{text(5)}.") for i, n in enumerate([8, 20, 50, 90, 300])]
    docs = [(i, text(k) + " " + t.upper().replace("\n", "  ") + " " + text(90)) for i, t in items for k in (0, 63, 200)]
    docs = [(100 + j, t) for j, (_, t) in enumerate(docs)] + [(i, text(500)) for i in range(40)]
    docs += [(50, items[2][1].split("?")[0] + text(60)), (51, None), (52, ""), (None, items[1][1])]           # 50: the question alone
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame([*items, (9, None), (10, "too short"), (None, "an item without a number, of enough words")], "item_id long, text string"))
    want = {(100 + j, j // 3) for j in range(15)} | {(None, 1)}
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_leaks_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in decontam.op1_decontamination(spark, SF).collect()}
    assert got == {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}


def test_shards_and_cases(spark, edges, clash, empty, monkeypatch):
    items = spark.createDataFrame([(i, f"{edge_rows()[11][1]} {i}", "tail ten words of an answer") for i in range(6)], "item_id long, question string, answer string")
    assert decontam.leaks(edges, items).count() == 0            # the question without the answer
    items = spark.createDataFrame([(i, " ".join(f"p{j}" for j in range(5 * i, 5 * i + 15))) for i in range(5)] * 2, "item_id long, text string")
    found = lambda **bound: sorted((r.doc_id is None, r.doc_id, r.item_id) for r in decontam.leaks(edges, items, **bound).collect())      # noqa: E731
    whole = found()
    parts = [index for index in decontam.shards(items, 40)]
    assert len(parts) >= 3 and sum(len(p.items) for p in parts) == 5 and whole          # 15 words each, repeated items once
    assert len([index for index in decontam.shards(items, 1)]) == 5                      # longer than a shard: one each
    assert found(words=40) == whole
    assert decontam.drop_leaks(edges, items, words=40).count() == decontam.drop_leaks(edges, items).count()
    kept = decontam.drop_leaks(clash, items)
    assert kept.columns == clash.columns
    hit = {r.doc_id for r in decontam.leaks(edges, items).collect()}
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in edge_rows()} - (hit - {13})
    assert decontam.leaks(empty, items).count() == 0 and decontam.leaks(edges, items.limit(0)).count() == 0
    assert decontam.drop_leaks(edges, items.limit(0)).count() == edges.count()


def test_short_items_and_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "He wrote: Zebra plum ink! Then he left."), (2, "zebra plum ink"), (3, "Zebra plum\n ink"), (4, "Zebra plum inks"), (5, "plum ink Zebra"),
                                  (6, "an answer:\n Osmium \nthe end"), (7, "Osmium is a metal"), (8, None), (9, ""), (10, "now this item has no number at all, friends"),
                                  (11, "Zebra plum, ink")], "doc_id long, text string")
    items = spark.createDataFrame([("1", "Zebra plum ink"), ("2", "Osmium"), ("none", "this item has no number at all"), (None, "Zebra  plum ink"), ("5", "?!"), ("6", "")],
                                  "item_id string, text string")
    got = sorted((r.doc_id, r.item_id or 0) for r in decontam.leaks(docs, items).collect())
    assert got == [(1, 0), (1, 1), (3, 0), (3, 1), (6, 2), (10, 0)]
    assert sorted(r.doc_id for r in decontam.drop_leaks(docs, items).collect()) == [2, 4, 5, 7, 8, 9, 11]


def test_long_items_make_a_small_index():
    rnd = random.Random(4)
    long = " ".join(f"w{rnd.randrange(40_000)}" for _ in range(60_000))
    index = decontam.Index([(1, long[: len(long) // 2], long[len(long) // 2:]), (2, "six words of a short item", "and its answer")])
    held = sum(x.nbytes for lists in (index.postings, index.block_max) for x in (lists.numbers, lists.weights, lists.start))
    assert held < 64 * 60_000                                                             # follows the words, not their square
    assert [x[1] for x in index.search(pa.array([long, long[1000:9000], "six words of a short item and its answer"]))] == [1, 2]


# ---- pipeline ----------------------------------------------------------------------------------

def test_pipeline_equals_brute_force(spark, reference, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or docs.columns == columns
        steps.append([tuple(r) for r in docs.collect()])
    rows = steps[0]
    assert rows and len(rows) < 200
    lines = {(i, t) for i, _, _, t in brute_lines(rows)}
    assert {r[:2] for r in steps[1]} == lines and all(len(r[1]) == r[4] for r in steps[1])
    near = brute_near(steps[1])
    assert {r[0] for r in steps[2]} == {i for i, (root, _) in near.items() if root == i}
    assert {r[0] for r in steps[3]} == {r[0] for r in steps[2] if not any(t in r[1] for t in items)}
    assert {(r[0], tuple(r[1])) for r in steps[4]} == {(r[0], tuple(reference.encode_ordinary(r[1]))) for r in steps[3]} and all(r[3] for r in steps[4])
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, whole)) == sorted((r[0], len(r[1])) for r in steps[4])


def test_exact_copies_leave_one_document(spark):
    sf = "/root/testdata/sf0.01"
    copy = "A line that stands in four documents.\nAnother line that stands in four documents.\n \t"
    rows = [(i, copy, "en", "s", len(copy)) for i in range(1, 5)] + [(5, "a text of its own", "en", "s", 17), (None, None, "en", "s", None)]
    lines = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf)
    assert sorted(r.doc_id for r in lines.collect() if r.doc_id and not r.text.strip()) == [1, 2, 3]
    got = corpus_pipeline.drop_near_duplicates(spark, lines, sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, ""), (4, copy), (5, "a text of its own")]
    whole = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens").collect()
    assert whole and all(r.n_tokens for r in whole)


def test_pipeline_cases(spark, edges, empty):
    for frame in (edges, empty):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() <= frame.count()
