"""Small tables with the odd cases that every corpus operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def odd_rows() -> list[tuple]:
    """Missing and empty values, white space only, a very long text, ties and repeated rows."""
    return [
        (1, "The quick brown fox jumps over the lazy dog and runs far away", "en", "a", 10),
        (2, "the quick brown fox jumps over the lazy dog and runs far away", "en", "a", 10),
        (2, "the quick brown fox jumps over the lazy dog and runs far away", "en", "a", 10),
        (None, "THE QUICK brown fox jumps over the lazy dog and runs far away", None, None, None),
        (3, None, "en", "b", None),
        (4, "", None, "b", 0),
        (5, " \n\t ", "de", None, 4),
        (6, LONG, "en", "a", len(LONG)),
        (7, "ÀÉ Straße naïve 中文 😀 \x00 end", "fr", "b", 1),
        (None, None, None, None, None),
    ]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def clashing(docs, *names: str):
    """`docs` with more columns that are named like what operators make."""
    from pyspark.sql import functions as F

    for name in names:
        docs = docs.withColumn(name, F.lit("other"))
    return docs


def prose(seed: int, words: int, vocabulary: int = 400) -> list[str]:
    draw = random.Random(seed)
    return [f"w{int(draw.expovariate(0.01)) % vocabulary}x{draw.randint(0, 9)}" for _ in range(words)]


def near_copies(seed: int = 0, groups: int = 12, copies: int = 6) -> list[tuple[int, str]]:
    """(id, text): groups of edited copies, equal copies with other white space, and texts of their own."""
    draw, rows = random.Random(seed), []
    for g in range(groups):
        base = prose(1000 + g, draw.randint(3, 160))
        for _ in range(draw.randint(1, copies)):
            words = list(base)
            for _ in range(draw.randint(0, 4)):
                words[draw.randrange(len(words))] = f"edit{draw.randint(0, 10**6)}"
            rows.append((len(rows), (" " if draw.random() < 0.8 else "\n ").join(words)))
    shared = " ".join(prose(5, 60))
    rows += [(len(rows) + i, shared + " " + " ".join(prose(2000 + i, draw.randint(5, 90)))) for i in range(15)]
    return rows
