"""Small document tables with everything that may be odd about them, and plain versions of the operators."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def near(text: str, seed: int, changes: int) -> str:
    r, w = random.Random(seed), text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = r.choice(VOCABULARY)
    return " ".join(w)


def odd_texts() -> list:
    base = prose(1, 120)
    return [
        base, base, near(base, 2, 2), near(base, 3, 3), near(base, 4, 40), base.upper(), f"  {base}\n", None, "", "   \n\t", "one two", "one two", "One  TWO", "12 34 !!", "é😀 ü ß",
        prose(5, 30_000), "x" * 60_000, " ".join(["again"] * 3_000), prose(6, 200), f"{prose(7, 40)} {prose(6, 200)} {prose(8, 40)}", prose(9, 5), prose(9, 4), "\x00\x01 a\x00b",
    ]


def odd_rows() -> list[tuple]:
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if i % 3 == 0 else 1) for i, t in enumerate(odd_texts())]
    return [*rows, rows[2], (None, "no id at all, but a text", "en", "s0", 1), (None, None, None, None, None)]


def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    clash = ["h", "k", "c", "n", "s", "e", "a", "b", "row", "rank", "length", "spans", "words", "component", "score", "range", "piece", "bands"]
    return docs.withColumns({c: F.lit("clash") for c in clash})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs) -> list[tuple]:
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
