import random

import pytest
from pyspark.sql import functions as F

from shelfspark.session import ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "A line of this text that three documents share. "


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


def edge_rows():
    """Nulls, empty, blank and long texts, ties, repeated rows, rows of one doc_id with other texts."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    passage = " ".join(f"p{i}" for i in range(40))
    near = [f"n{i}" for i in range(120)]
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n \x0b", "en", None, 3), (None, "a text without an id " * 4, "en", "s", None),
            (None, None, None, None, None), (4, LINE + "\nown line of four that is long enough\n" + LINE.upper(), "en", "s", 1),
            (5, "  " + LINE.upper() + "\t\nshort", "en", "s", 1), (6, "x\n" + LINE + "\n\n", "fr", "s", 1), (7, "ÀÉ same TEXT", "fr", "s", 1),
            (8, "ÀÉ Same text", "fr", "s", 1), (9, "àé same text", "fr", "s", 1), (10, passage + " tail ten", "de", "s", 1), (11, "head " + passage, "de", "s", 1),
            (12, passage + " " + passage, "de", "s", 1), (12, passage + " " + passage, "de", "s", 1), (13, "one text", "en", "s", 1), (13, passage + " of the same id", "en", "s", 1),
            (14, "日本語 テキスト 😀 " * 30, None, "s", 1), (15, "a" * 5000, None, "s", 1), (16, "12 34 !!", "en", "s", 1), (-5, passage, "de", "s", 1),
            (17, " ".join(rnd.choice(words) for _ in range(60_000)), "es", "s", 1), (18, " ".join(near), "en", "s", 1)]
    for i in range(30):                                   # near copies: one word changed each
        w = list(near)
        w[4 * i % 120] = f"c{i}"
        rows.append((100 + i, " ".join(w), "en", "hot", 1))
    rows += [(200 + i, " ".join(rnd.choice(words[:3]) for _ in range(20)), "en", "hot", 1) for i in range(40)]
    rows += [(300 + i, "An exact copy of one text, held by many documents in this table.", "en", "hot", 1) for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clash(edges):
    """The same table with more columns, of names that operators use themselves."""
    names = ["key", "keys", "id", "c0", "c1", "row", "h", "runs", "n_lines", "n_words", "token_ids", "findings", "score", "mean_log_ratio"]
    return edges.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
