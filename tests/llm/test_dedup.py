import hashlib
import re
import tempfile
from collections import Counter, defaultdict

import duckdb
import pytest

from shelfspark.llm import exact_dedup, jaccard, line_dedup, queries, substring_dedup
from shelfspark.session import checkpoint_dir
from tests.llm.corpus_fixtures import clash, edge_rows, edges, empty, shipped  # noqa: F401  fixtures

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", ["op4_line_dedup", "op5_substring_dedup", "op10_exact_dedup"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def brute_lines(rows):
    held, last = defaultdict(set), {}
    key = lambda x: ascii_lower(x.strip(WHITE))                                   # noqa: E731
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                held[key(x)].add(i)
    last = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or last.get(key(x), i) <= i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


@pytest.mark.parametrize("log2", [12, 20])             # 12: a filter far too small for its input
def test_lines_equal_brute_force(edges, log2):
    got = line_dedup.dedup_lines(edges, log2=log2 + 6).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert Counter(map(tuple, got)) == brute_lines(edge_rows())


def test_lines_keep_other_columns(clash, empty):
    got = line_dedup.dedup_lines(clash)
    assert got.columns == [c for c in clash.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert {(r.key, r.keys, r.id, r.c0) for r in got.collect()} == {(0, 1, 2, 3)}
    assert line_dedup.dedup_lines(empty).count() == 0


def brute_substrings(rows):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for j in range(len(w) - 12):
            k = tuple(w[j: j + 13])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = set()
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j: j + 13])] < i:
                gone.update(range(j, j + 13))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return Counter(out)


@pytest.mark.parametrize("log2", [18, 22])
def test_substrings_equal_brute_force(edges, log2):
    got = substring_dedup.remove_repeats(edges, log2=log2).select("doc_id", "n_words", "n_removed", "text").collect()
    assert Counter(map(tuple, got)) == brute_substrings(edge_rows())


def test_substrings_keep_other_columns(clash, empty):
    got = substring_dedup.remove_repeats(clash)
    assert got.columns == [c for c in clash.columns if c != "n_words"] + ["n_words", "n_removed"]
    assert {(r.key, r.runs, r.id, r.c0) for r in got.collect()} == {(0, 7, 2, 3)}
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_exact_equals_brute_force(spark, edges, empty):
    index = exact_dedup.DigestIndex(spark, tempfile.mkdtemp(dir=checkpoint_dir(spark)), 4)
    got = exact_dedup.exact_dedup(edges, index).collect()
    groups = defaultdict(list)
    for i, t, *_ in edge_rows():
        groups[sha(ascii_lower(t or ""))].append(i)
    want = []
    for h, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), keep is None or i == keep, h) for i in ids]
    assert Counter(map(tuple, got)) == Counter(want)
    again = exact_dedup.DigestIndex(spark, tempfile.mkdtemp(dir=checkpoint_dir(spark)), 4)
    assert exact_dedup.exact_dedup(empty, again).count() == 0


def test_index_persists_and_appends(spark):
    path = tempfile.mkdtemp(dir=checkpoint_dir(spark))
    rows = lambda *x: spark.createDataFrame(x, "doc_id long, text string")        # noqa: E731
    first = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.exact_dedup(rows((1, "One"), (2, "one"), (3, "two")), first)
    first.close()                                                                   # the folder stays
    index = exact_dedup.DigestIndex(spark, path)
    assert index.buckets == 4
    got = exact_dedup.exact_dedup(rows((10, "ONE"), (11, "three"), (12, "Three"), (0, "TWO")), index)
    assert {(r.doc_id, r.keep_id, r.kept, r.group_size) for r in got.collect()} == {(10, 10, True, 3), (11, 12, False, 2), (12, 12, True, 2), (0, 3, False, 2)}
    assert index.read().count() == 3 and index.changes().count() == 2
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.DigestIndex(spark, path, 5)


@pytest.mark.parametrize("batches", [2, 5])
def test_exact_in_batches_equals_one_batch(spark, edges, batches):
    one, many = (exact_dedup.DigestIndex(spark, tempfile.mkdtemp(dir=checkpoint_dir(spark)), 4) for _ in range(2))
    want = exact_dedup.exact_dedup(edges, one).collect()
    assert Counter(map(tuple, exact_dedup.exact_dedup(edges, many, batches).collect())) == Counter(map(tuple, want))
    assert many.read().count() == one.read().count() and many.changes().count() > 0 and one.changes().count() == 0


def test_a_batch_that_is_run_again_counts_once(spark, monkeypatch):
    index = exact_dedup.DigestIndex(spark, tempfile.mkdtemp(dir=checkpoint_dir(spark)), 4)
    batch = lambda *x: exact_dedup.digests(spark.createDataFrame(x, "doc_id long, text string"))        # noqa: E731
    index.append(batch((1, "a"), (2, "b")), "first")
    real = exact_dedup.DigestIndex.known
    monkeypatch.setattr(exact_dedup.DigestIndex, "known", lambda *a: 1 / 0)         # fails before anything is appended
    with pytest.raises(ZeroDivisionError):
        index.append(batch((3, "a"), (4, "c"), (5, "c")), "second")
    monkeypatch.setattr(exact_dedup.DigestIndex, "known", real)
    for _ in range(3):
        index.append(batch((3, "a"), (4, "c"), (5, "c")), "second")
    sizes = {(r.keep_id, r.group_size) for r in index.state().collect()}
    assert sizes == {(3, 2), (2, 1), (5, 2)} and index.read().count() == 3 and index.changes().count() == 1


def test_index_side_is_not_shuffled(spark):
    index = exact_dedup.DigestIndex(spark, tempfile.mkdtemp(dir=checkpoint_dir(spark)), 8)
    new = exact_dedup.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    for joined in (index.missing(new), index.lookup(new)):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def brute_near(rows, least=0.8):
    sets, copies = {}, Counter()
    for i, t, *_ in rows:
        w = words_of(ascii_lower(t or ""))
        if i is not None and w:
            sets.setdefault((i, frozenset(tuple(w[j: j + 5]) for j in range(max(1, len(w) - 4)))), 0)
            copies[i, frozenset(tuple(w[j: j + 5]) for j in range(max(1, len(w) - 4)))] += 1
    keys = list(sets)
    root = {i: i for i, *_ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    links = Counter({k: copies[k] - 1 for k in keys})
    for a, (i, s) in enumerate(keys):
        for j, t in keys[:a]:
            if s and len(s & t) / len(s | t) >= least:
                links[i, s] += copies[j, t]
                links[j, t] += copies[i, s]
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (find(i), max((n for (j, _), n in links.items() if j == i), default=0)) for i in root}


@pytest.mark.parametrize("small", [512, 3])            # 3: pivots, child paths and blocks are all used
def test_near_duplicates_equal_brute_force(spark, edges, monkeypatch, small):
    if small == 3:
        monkeypatch.setattr(jaccard, "SMALL", 3)
        monkeypatch.setattr(jaccard, "PART", 8)
        monkeypatch.setattr(jaccard, "BLOCK", 8)
        monkeypatch.setattr(jaccard, "DEPTH", 2)
    rows = [r for r in edge_rows() if r[0] != 13]       # 13 has two texts: tested below
    got = jaccard.near_duplicates(spark.createDataFrame(rows, edges.schema)).collect()
    want = brute_near(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got if r.doc_id is not None} == want
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)] * 2 and len(got) == len(rows)


def test_near_duplicates_cases(edges, empty):
    assert jaccard.near_duplicates(empty).count() == 0
    rows = jaccard.near_duplicates(edges).collect()
    assert len({r.class_id for r in rows if r.doc_id == 13}) == 1
    got = {r.doc_id: r.class_id for r in rows}
    assert got[300] == got[319] == 300 and got[1] == 1 and got[2] == 2


def test_near_duplicates_of_the_table(spark):
    got = jaccard.op2_jaccard_join(spark, SF).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_near(rows)


def test_no_pairs_of_a_group_as_rows(spark):
    """A group of n near copies makes rows in proportion to n, not to its square."""
    near = [f"n{i}" for i in range(200)]
    rows = [(i, " ".join([*near[:i % 200], f"c{i}", *near[i % 200 + 1:]])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reps = jaccard.signatures(docs).withColumnRenamed("doc_id", "id").select("id", "sig")
    assert jaccard.coarse_edges(reps).count() < 300 * 2 * jaccard.RUNS * 2
    got = jaccard.near_duplicates(docs).collect()
    assert {r.class_id for r in got} == {0} and all(r.n_links == 299 for r in got)
