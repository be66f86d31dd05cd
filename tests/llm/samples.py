"""Small tables with every case that operators have to bear."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and in to that was for with as on be at by it from er an th on ti".split()


def sentence(r: random.Random, words: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(words))


def odd_rows(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty, blank, repeated, tied and long texts, shared lines."""
    r = random.Random(seed)
    line = "This line, of some length, is shared. "
    long = sentence(r, 30_000)
    rows = [
        (None, None, None, None, None),
        (None, "a text without an id", "en", None, 5),
        (1, None, "en", "s", 0),
        (2, "", None, "s", 0),
        (3, " \t\n\x0b\x0c\r ", "de", None, 7),
        (4, "\n\n", "de", "s", 2),
        (5, long, "en", "s", len(long)),
        (6, long + " end", "en", "s", len(long) + 4),
        (7, "K İ Été naïve \U0001f600 x́", "fr", "s", 3),
        (8, f"{line}\n{line.upper()}\nown {sentence(r, 9)}", "en", "s", 3),
        (9, f"{line}\n\n  {line}\t", "en", "s", 3),
        (10, line, "en", "s", 3),
        (10, line, "en", "s", 3),
        (10, line + "but other text", "en", "t", 3),
        (11, "word " * 300, "en", "s", 3),
    ]
    rows += [(20 + i, sentence(r, r.randrange(60)), "en", "s", 0) for i in range(40)]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def with_clashes(docs):
    """The same rows with more columns, of names that operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["_id", "_text", "_row", "_k1", "_fp", "shard", "score", "kept", "n_words", "labels"]
    names += ["found", "a.b", "pos", "h", "_found", "_judged", "given", "judged", "sh", "s0", "_n"]
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


def lowered(text) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (text or "").translate(str.maketrans(upper, upper.lower()))


def same(rows) -> list:
    return sorted(map(repr, map(tuple, rows)))
