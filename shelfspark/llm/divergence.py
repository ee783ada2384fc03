"""Source divergence audit by chunk factorization.

Whitespace chunks are counted per document and added up within a task; the sums go to segments by the
chunk's hash, a row of many chunks each. In its segment each globally distinct chunk is tokenized once, and
its terms meet its counts: occurrences by source, and documents of the language. Spellings of a term share a
segment, so they are added up there. That table is written once. Chunks are held in Arrow dictionaries and
counted in numpy, without a Python object for a word.

Distinct documents of a term do not add up (one document may hold it in several chunks), so a term first
gets two exact bounds on its documents in a language: at least those of its most common chunk (or those that
a segment has numbered), at most the sum over its chunks. Only terms whose bounds lie on both sides of the limit have their documents counted one
by one, from the document numbers kept beside chunks of few documents.

The sum of a pair of sources over all kept terms is taken apart: terms that one of them lacks have a
constant probability there, so histograms of counts give that share, and only terms in both are joined.

Cases: null text, lang and source are ''; a group without terms appears with all its pairs; with no kept term
every pair has value 0; each row is a document of its own, repeated rows and rows without a doc_id included
(doc_id is not read); equal values rank by item; other columns are not read; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm import vec
from shelfspark.llm.tables import written_table
from shelfspark.llm.vec import column

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
HELD = 2_000_000                   # chunks of documents, each document's own counted, that a task holds before it passes them on
ROWS_OUT = 50_000
LEAST_SEGMENTS = 64
#: Byte -> byte of a lower-cased chunk as ``TERM`` sees it: ASCII but letters separates, A-Z are lower-cased.
TERM_LUT = vec.LOWER_LUT.copy()
TERM_LUT[[b for b in range(128) if not chr(b).isalpha()]] = 32
_PACKED = pa.schema([("segment", pa.int32()), ("lang", pa.string()), ("sources", pa.list_(pa.string())),
                     *[(c, pa.binary()) for c in ("chunks", "docs", "held", "rows", "parts", "source", "n")]])
_TERMS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("most", pa.int64()), ("rows", pa.list_(pa.int64()))])


class _Held:
    """What a task holds of a language: distinct chunks of each batch of documents, and where they stand how often."""

    def __init__(self):
        self.sources, self.parts = {}, []

    def add(self, numbers: np.ndarray, sources: list[str], texts: pa.Array) -> int:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))                    # both change or cut at ASCII alone
        chunks = lists.flatten().dictionary_encode()
        code, size = chunks.indices.to_numpy().astype(np.int64), len(chunks.dictionary)
        key = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy()) * size + code
        key, n = _counted(key[code != pc.index(chunks.dictionary, "").as_py()], None)
        row, code = np.divmod(key, size) if size else (key, key)
        source = np.array([self.sources.setdefault(s, len(self.sources)) for s in sources], np.int32)
        self.parts.append((pa.DictionaryArray.from_arrays(pa.array(code, pa.int32()), chunks.dictionary), numbers[row], source[row], n))
        return len(key)

    def pack(self, min_docs: int, segments: int):
        """By segment: its chunks in a line, and arrays of their documents, of their documents' numbers, and of their parts."""
        chunks = pa.chunked_array([x[0] for x in self.parts]).unify_dictionaries()
        names = chunks.chunk(0).dictionary
        code = np.concatenate([c.indices.to_numpy() for c in chunks.chunks])
        number, source, n = (np.concatenate([x[i] for x in self.parts]) for i in (1, 2, 3))
        segment = _segments(names, segments)
        segment[np.bincount(code, minlength=len(names)) == 0] = -1
        order = np.argsort(segment, kind="stable")
        order = order[segment[order] >= 0]
        place = np.full(len(names), -1, np.int64)
        place[order] = np.arange(len(order))
        at = place[code]
        number, source, n, at = (x[at >= 0] for x in (number, source, n, at))
        docs = np.bincount(at, minlength=len(order))
        rare = docs[at] < min_docs
        rows_of, rows = _sorted(at[rare], number[rare])
        key, n = _counted(at * len(self.sources) + source, n)
        parts_of, source = np.divmod(key, len(self.sources))
        held, parts = np.bincount(rows_of, minlength=len(order)), np.bincount(parts_of, minlength=len(order))
        edge = np.searchsorted(segment[order], np.arange(segments + 1))
        row_edge, part_edge = np.searchsorted(rows_of, edge), np.searchsorted(parts_of, edge)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), names.take(pa.array(order))), " ")
        for k in np.flatnonzero(np.diff(edge)).tolist():
            own, r, p = (slice(e[k], e[k + 1]) for e in (edge, row_edge, part_edge))
            yield k, list(self.sources), lines[k].as_py().encode(), *(x.tobytes() for x in (
                docs[own].astype(np.uint32), held[own].astype(np.uint32), rows[r], parts[own].astype(np.uint32), source[p].astype(np.uint32), n[p].astype(np.uint32)))


def _sorted(key: np.ndarray, *values: np.ndarray):
    order = np.argsort(key, kind="stable")
    return key[order], *(v[order] for v in values)


def _counted(key: np.ndarray, n: np.ndarray | None):
    """Distinct keys in order, and their sums of ``n`` (None: how often they come)."""
    if n is None:
        key = np.sort(key)
    else:
        key, n = _sorted(key, n)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    if n is None:
        return key[first], np.diff(first, append=len(key))
    return key[first], np.add.reduceat(n.astype(np.int64), first) if len(first) else n.astype(np.int64)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., ``count`` of them, for each entry."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _segments(chunks: pa.Array, segments: int) -> np.ndarray:
    """The segment of each chunk, -1 without a term. Spellings of one term with up to two other bytes go together, so that
    they are added up there; any other chunk goes by itself."""
    out = np.full(len(chunks), -1, np.int64)
    for lo, _, buf, offs in vec.slices(chunks):
        s, e, row, term = vec.words(buf, offs, TERM_LUT)
        _, _, whole_row, whole = vec.words(buf, offs)
        h, size = np.zeros(len(offs) - 1, np.uint64), np.diff(offs)
        h[whole_row] = whole
        terms = np.bincount(row, minlength=len(h))
        one = (terms[row] == 1) & (size[row] - (e - s) <= 2)
        h[row[one]] = term[one]
        out[lo: lo + len(h)] = np.where(terms > 0, (h % np.uint64(segments)).astype(np.int64), -1)
    return out


def chunk_counts(docs: DataFrame, segments: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """Documents that hold a chunk and its occurrences by source, added up within a task: a row a segment and language. ``rows``
    numbers the documents of a chunk where there are fewer than ``min_docs``. Chunks have A-Z lower-cased."""
    vec.bounded_batches(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def flush(held):
        for lang, sums in held.items():
            for segment, *rest in sums.pack(min_docs, segments):
                yield vec.batch_of(_PACKED, [segment], [lang], *([x] for x in rest))

    def count(batches):
        number = TaskContext.get().partitionId() << 40
        held, pairs = {}, 0
        for b in batches:
            langs = column(b, "lang").dictionary_encode()
            of, sources, texts = langs.indices.to_numpy(), column(b, "source").to_pylist(), column(b, "text")
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.flatnonzero(of == k)
                pairs += held.setdefault(lang, _Held()).add(number + own, [sources[i] for i in own.tolist()], texts.take(pa.array(own)))
            number += len(b)
            if pairs >= HELD:
                yield from flush(held)
                held, pairs = {}, 0
        yield from flush(held)

    return plain.mapInArrow(count, "segment int, lang string, sources array<string>, chunks binary, docs binary, held binary, rows binary, "
                            "parts binary, source binary, n binary")


class _Segment:
    """Chunks of a segment and language: packed pieces as they come, added up when as many again have come as are held."""

    def __init__(self, min_docs: int):
        self.min_docs, self.sources, self.pieces, self.merged = min_docs, {}, [], 0

    def add(self, sources: list[str], chunks: bytes, docs, held, rows, parts, source, n) -> None:
        docs, held, parts, source, n = (np.frombuffer(x, np.uint32).astype(np.int64) for x in (docs, held, parts, source, n))
        ids = np.array([self.sources.setdefault(s, len(self.sources)) for s in sources], np.int64)
        self.pieces.append((pc.split_pattern(pa.array([chunks.decode()]), " ").flatten(), docs, held, np.frombuffer(rows, np.int64), parts, ids[source], n))
        if sum(len(p[-1]) for p in self.pieces[1:]) > max(HELD, self.merged):
            self.merge()

    def merge(self):
        """One piece of all, in which each chunk stands once."""
        chunks = pa.concat_arrays([p[0] for p in self.pieces]).dictionary_encode()
        code, size = chunks.indices.to_numpy().astype(np.int64), len(chunks.dictionary)
        docs, held, rows, parts, source, n = (np.concatenate([p[i] for p in self.pieces]) for i in range(1, 7))
        rows_of, part_of = np.repeat(code, held), np.repeat(code, parts)
        by, n = _counted(part_of * len(self.sources) + source, n)
        part_of, source = np.divmod(by, len(self.sources))
        code, docs = _counted(code, docs)
        rare = docs[rows_of] < self.min_docs
        rows_of, rows = _sorted(rows_of[rare], rows[rare])
        self.pieces = [(chunks.dictionary, docs, np.bincount(rows_of, minlength=size), rows, np.bincount(part_of, minlength=size), source, n)]
        self.merged = len(n)
        return self.pieces[0]

    def terms(self, lang: str):
        """Batches of ``_TERMS``: each chunk is tokenized, and its counts go to its terms."""
        chunks, docs, held, rows, parts, source, n = self.merge()
        buf, offs = vec.text_buffer(chunks)
        lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(chunks), pa.py_buffer(np.ascontiguousarray(offs)), pa.py_buffer(TERM_LUT[buf])))
        words = lists.flatten().dictionary_encode()
        word, size = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
        key = word * len(chunks) + np.repeat(np.arange(len(chunks)), lists.value_lengths().to_numpy())
        key, times = _counted(key[word != pc.index(words.dictionary, "").as_py()], None)
        if not len(key):
            return
        word, chunk = np.divmod(key, len(chunks))                                   # by word, a row a chunk that holds it
        part = _spread((np.cumsum(parts) - parts)[chunk], parts[chunk])
        by, total = _counted(np.repeat(word, parts[chunk]) * len(self.sources) + source[part], np.repeat(times, parts[chunk]) * n[part])
        of, source = np.divmod(by, len(self.sources))
        none = lambda k, kind: pa.nulls(k, kind)
        yield words.dictionary.take(pa.array(of)), pa.array(list(self.sources), pa.string()).take(pa.array(source)), pa.array(total), none(len(by), pa.int64()), none(len(by), _TERMS.field("rows").type)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        seen, least, most = word[first], np.maximum.reduceat(docs[chunk], first), np.add.reduceat(docs[chunk], first)
        row_of, row = np.repeat(word, held[chunk]), rows[_spread((np.cumsum(held) - held)[chunk], held[chunk])]
        order = np.lexsort((row, row_of))
        row_of, row = row_of[order], row[order]
        new = np.concatenate([np.ones(min(1, len(row)), bool), (row_of[1:] != row_of[:-1]) | (row[1:] != row[:-1])])
        row_of, row = row_of[new], row[new]
        at_least = np.zeros(size, np.int64)
        at_least[seen] = np.maximum(least, np.bincount(row_of, minlength=size)[seen])
        row_of, row = (x[at_least[row_of] < self.min_docs] for x in (row_of, row))
        edges = np.concatenate([[0], np.cumsum(np.bincount(row_of, minlength=size)[seen])])
        yield (words.dictionary.take(pa.array(seen)), none(len(seen), pa.string()), pa.array(at_least[seen]), pa.array(most),
               pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(row, pa.int64())))


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n, most, rows), added up within a segment: for each term a row a source with its occurrences, and one
    with source null, at least so many documents (n), at most so many, and the documents' numbers where n is under ``min_docs``."""
    segments = max(LEAST_SEGMENTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def tokenize(batches):
        whole: dict[int, dict[str, _Segment]] = {}
        for b in batches:
            for segment, lang, *packed in zip(*(column(b, f.name).to_pylist() for f in _PACKED), strict=True):
                whole.setdefault(segment, {}).setdefault(lang, _Segment(min_docs)).add(*packed)
        for langs in whole.values():
            for lang, held in langs.items():
                for term, *rest in held.terms(lang):
                    out = vec.batch_of(_TERMS, pa.repeat(lang, len(term)), term, *rest)
                    for i in range(0, len(out), ROWS_OUT):
                        yield out.slice(i, ROWS_OUT)

    packed = chunk_counts(docs, segments, min_docs).repartitionById(segments, F.col("segment"))
    return packed.mapInArrow(tokenize, "lang string, term string, source string, n long, most long, rows array<long>")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, c): occurrences, per source, of the terms in at least ``min_docs`` documents of the language."""
    counts = written_table(term_counts(docs, min_docs), "term_counts")
    in_docs = counts.filter(F.col("source").isNull())
    bounds = written_table(in_docs.groupBy("lang", "term").agg(F.max("n").alias("least"), F.sum("most").alias("most"))
                           .filter(F.col("most") >= min_docs), "term_bounds")
    # a segment that knows fewer than min_docs documents of a term gives their numbers, so those of open terms are all there
    closed = (in_docs.join(bounds.filter(F.col("least") < min_docs), ["lang", "term"]).select("lang", "term", F.explode("rows").alias("row"))
              .groupBy("lang", "term").agg(F.count_distinct("row").alias("docs")).filter(F.col("docs") >= min_docs))
    kept = bounds.filter(F.col("least") >= min_docs).select("lang", "term").unionByName(closed.select("lang", "term"))
    return (counts.filter(F.col("source").isNotNull()).groupBy("lang", "term", "source").agg(F.sum("n").alias("c"))
            .join(kept, ["lang", "term"], "left_semi"))


def _p(count: Column | str, n: str, v: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (n + 2 v)), exact."""
    return F.expr(f"1 + (cast({count} + 2 as decimal(20,0)) * {SCALE}) div cast({n} + 2 * {v} as decimal(20,0))")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources of a language, and the terms that tell a source apart."""
    kept = written_table(kept_terms(docs, min_docs), "kept_terms")
    langs = kept.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("c").alias("n_lang"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("own"))
    groups = written_table(
        docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        .join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0, ["v", "n_lang", "n", "own"])
        .withColumn("p0", F.when(F.col("v") > 0, _p("0", "n", "v"))), "groups")

    per_term = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "c", "p0", _p("c", "n", "v").alias("p"), "v", "n_lang")
    a, b = (groups.select("lang", F.col("source").alias(f"{x}"), F.col("p0").alias(f"p0{x}"), F.col("own").alias(f"own{x}"), "v") for x in "ab")
    pairs = a.join(b.drop("v"), "lang").filter(F.col("a") != F.col("b"))               # one row for each row of the result
    # terms of one source against the other's constant: as many rows as it has different counts
    hist = (per_term.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
            .join(groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0")), "lang").filter(F.col("source") != F.col("other"))
            .groupBy("lang", "source", "other").agg(F.sum(F.col("m") * _f("p", "q0")).alias("alone")))
    # terms in both: corrected from the constants to both probabilities; f is symmetric, so one order of a pair is enough
    x, y = (per_term.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p{s}"), F.col("p0").alias(f"p0{s}")) for s in "ab")
    both = (x.join(y, ["lang", "term"]).filter(F.col("a") < F.col("b")).groupBy("lang", "a", "b")
            .agg(F.sum(_f("pa", "pb") - _f("pa", "p0b") - _f("p0a", "pb") + _f("p0a", "p0b")).alias("shared")))
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    to = lambda one, other, name: hist.select("lang", F.col("source").alias(one), F.col("other").alias(other), F.col("alone").alias(name))
    keys = ["lang", "a", "b"]
    value = (F.coalesce("alone_a", F.lit(0)) + F.coalesce("alone_b", F.lit(0)) + F.coalesce("shared", F.lit(0))
             + (F.col("v") - F.col("owna") - F.col("ownb")) * F.coalesce(_f("p0a", "p0b"), F.lit(0)))
    pair = (pairs.join(to("a", "b", "alone_a"), keys, "left").join(to("b", "a", "alone_b"), keys, "left").join(both, keys, "left")
            .select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.cast("long").alias("value")))

    totals = kept.groupBy("lang", "term").agg(F.sum("c").alias("c_lang"))
    term = (per_term.join(totals, ["lang", "term"]).withColumn("q", _p("c_lang", "n_lang", "v")).filter("c > 0 and p > q")
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").cast("long").alias("value")))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(w))                  # noqa: E731
    return ranked(pair).unionByName(ranked(term).filter(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
             1 + (1000000000 * (coalesce(c.c, 0) + 2)::HUGEINT) // (coalesce(n.n, 0) + 2 * v.v)::HUGEINT AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(c) + 2)::HUGEINT) // (sum(sum(c)) OVER (PARTITION BY lang) + 2 * any_value(v))::HUGEINT AS q
      FROM p JOIN v USING (lang) GROUP BY 1, 2),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tm AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
       FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pr UNION ALL FROM tm))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
