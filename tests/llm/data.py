"""Small tables with every odd case, for the training-data operators."""

from __future__ import annotations

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    parts = ["ka", "lo", "mi", "ren", "sto", "ti", "vu", "an", "el", "or"]
    words = ["".join(r.choice(parts, r.integers(1, 5))) for _ in range(n)]
    return " ".join(words)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    base = prose(1, 400)
    long = prose(2, 30_000)
    near = base.split()
    near[200] = "changed"
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, " ".join(near), "en", "b", 2),
        (4, long, "fr", "b", 3), (5, "", "en", "a", 0), (6, None, "fr", "b", 0), (7, prose(3, 300), None, "c", 1),
        (8, prose(4, 300), "en", None, 1), (None, prose(5, 300), "en", "a", 1), (None, None, None, None, None),
        (9, " \n\t ", "en", "c", 3), (10, "one two", "en", "c", 7), (11, "One  TWO", "en", "c", 8),
        (12, "12 34 &&", "en", "c", 8), (13, "é" * 300 + " <|endoftext|> naïve   x\x1cy 's don't", "fr", "d", 9),
        (14, "ha " * 500, "en", "d", 1500),
    ]
    return rows


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'x' AS _id", "1 AS size", "2 AS n_words", "3 AS _text", "4 AS length", "5 AS _cls", "6 AS _h", "7 AS taken")
