"""Small tables with all that can be odd about rows, and random prose."""

from __future__ import annotations

import random

#: Columns whose names the operators use inside; none of them may matter.
CLASHING = ("row_key", "fp", "nth", "root", "n", "score", "keep", "shard", "v", "cell", "host", "label", "__row_key", "tokens")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi", "nu", "ro", "sta", "tre") for b in ("ma", "ni", "po", "ru", "vel", "zon") for c in ("", "d", "n", "rs", "ly", "ti")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out, at = [], 0
    while at < n:
        k = min(n - at, rng.randint(5, 14))
        out.append(" ".join(rng.choice(WORDS) for _ in range(k)).capitalize() + ".")
        at += k
    return " ".join(out)


def changed(text: str, seed: int, share: float) -> str:
    """The text with a share of its words replaced."""
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def docs(spark, rows, extra: bool = True):
    """documents from (id, text) pairs; with columns whose names clash with those used inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHING]) if extra else df


def odd(*more):
    """Rows that every operator has to bear: nulls, empty, blank, repeated and very long texts, odd characters."""
    long = prose(99, 120_000)
    return [(1, None), (None, None), (2, ""), (3, " \n\t "), (4, "?!... --"), (None, "a text without an id"), (5, "word"), (5, "word"), (6, long), (7, "x" * 200_000), (8, "\u0000� 漢字 😀 İstanbul"), *more]


def rows(df, *columns):
    """Collected rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
