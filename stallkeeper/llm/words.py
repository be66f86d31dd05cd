"""Words of texts and hashes of word sequences, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallkeeper.llm.scratch import let

# What parts words once A-Z are in lower case, the same before, and white space.
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
NO_WORD_YET = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
BLANKS = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(text: Column, separator: str) -> Column:
    """What stands between separators; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator, -1), lambda part: part != "")


def lower_words(text: Column) -> Column:
    """Words of letters and digits, and of any character beyond ASCII, A-Z in lower case."""
    return parts(F.translate(text, UPPER, LOWER), NO_WORD)


def count_words(text: Column) -> Column:
    """How many `lower_words` there are. Only the first and the last part can be empty."""
    return let(
        F.split(F.coalesce(text, F.lit("")), NO_WORD_YET, -1),
        lambda p: F.size(p).cast("bigint")
        - (p[0] == "").cast("bigint")
        - ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("bigint"),
    )


def _joined(left: Column, right: Column, apart: int) -> Column:
    """Hash of each value of `left` with the value of `right` that stands `apart` places on."""
    return let(
        F.struct(left.alias("l"), right.alias("r")),
        lambda v: let(
            F.greatest(F.size(v["r"]) - apart, F.lit(0)),
            lambda n: F.zip_with(
                F.slice(v["l"], 1, n),
                F.slice(v["r"], apart + 1, n),
                lambda a, b: F.xxhash64(a, b),
            ),
        ),
    )


def sequence_hashes(words: Column, length: int) -> Column:
    """A 64-bit hash of each `length` words in a row, by place; made by doubling."""
    singles = F.transform(words, lambda word: F.xxhash64(word))

    def of(singles: Column, n: int) -> Column:
        if n == 1:
            return singles
        if n % 2:
            return _joined(of(singles, n - 1), singles, n - 1)
        half = of(singles, n // 2)
        return let(half, lambda h: _joined(h, h, n // 2))

    return let(singles, lambda s: of(s, length))
