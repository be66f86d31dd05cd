"""Keys at given ranks of a table, by counting instead of sorting.

A row's key is a whole number and, among equal numbers, a text. The key at a rank is found by
counting rows exactly in parts of the interval that holds it, then in parts of that part, until one
number is left; among its rows, by counting texts by how they go on. All dimensions and ranks are
narrowed in the same passes. What comes to the driver are counts, for each interval at
most 2 ** `PART_BITS` or as many as there are pairs of characters, and the last few texts.
"""

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_BITS = 14
# Texts of so many rows are looked at one by one.
FEW_ROWS = 1000
# Texts go on by so many characters in a pass.
_STEP = 2

Key = tuple[int | None, str | None]


@dataclass
class _Target:
    """A rank, and the interval of numbers, then the beginning of texts, that it lies in."""

    dimension: int
    rank: int  # from 1, within what is left
    low: int = 0
    bits: int = 0
    prefix: str | None = ""  # None: the text is NULL
    rows: int = 0
    done: bool = False

    def part(self) -> tuple:
        return self.dimension, self.low, self.bits, self.prefix

    def take(self, counts: list[tuple[int, int]]) -> int:
        """Of parts in order, with their rows, the one that has the rank."""
        for (which, rows), upto in zip(counts, accumulate(n for _, n in counts), strict=True):
            if self.rank <= upto:
                self.rank -= upto - rows
                self.rows = rows
                return which
        raise ValueError("the rows changed while they were counted")


def _counted(rows: DataFrame, parts: list[tuple[tuple, Column, Column]]) -> dict:
    """Rows of each part by the value of its last column, combined before the shuffle."""
    tagged = F.array(
        *[
            F.when(inside, F.struct(F.lit(i).alias("part"), value.alias("value")))
            for i, (_, inside, value) in enumerate(parts)
        ]
    )
    counted = rows.select(F.explode(tagged).alias("t")).where("t IS NOT NULL")
    found = counted.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()
    by_part: dict = {part: [] for part, _, _ in parts}
    for row in found:
        by_part[parts[row.t.part][0]].append((row.t.value, row.n))
    return {
        part: sorted(values, key=lambda v: (v[0] is not None, v[0]))
        for part, values in by_part.items()
    }


def _narrow_numbers(rows: DataFrame, targets: list[_Target]) -> None:
    while open_targets := [t for t in targets if t.bits]:
        parts = []
        for dimension, low, bits, prefix in {t.part() for t in open_targets}:
            step = max(0, bits - PART_BITS)
            value = F.col("values")[dimension]
            above = value - F.lit(low)
            inside = (value >= low) & (F.shiftright(above, bits) == 0)
            parts.append(((dimension, low, bits, prefix), inside, F.shiftright(above, step)))
        counts = _counted(rows, parts)
        for t in open_targets:
            step = max(0, t.bits - PART_BITS)
            t.low, t.bits = t.low + (t.take(counts[t.part()]) << step), step


def _narrow_texts(rows: DataFrame, targets: list[_Target]) -> None:
    text = F.col("text")
    while open_targets := [t for t in targets if t.rows > FEW_ROWS and not t.done]:
        parts = []
        for part in {t.part() for t in open_targets}:
            dimension, low, _, prefix = part
            inside = F.col("values")[dimension] == low
            if prefix:
                inside &= text.startswith(prefix)
            parts.append((part, inside, text.substr(len(prefix) + 1, _STEP)))
        counts = _counted(rows, parts)
        for t in open_targets:
            more = t.take(counts[t.part()])
            if more is None:
                t.prefix = None
            else:
                t.prefix += more
            t.done = not more  # no text goes on from it, and no other is the same
    few = [t for t in targets if not t.done]
    if not few:
        return
    parts = []
    for part in {t.part() for t in few}:
        inside = F.col("values")[part[0]] == part[1]
        if part[3]:
            inside &= text.startswith(part[3])
        parts.append((part, inside, text))
    counts = _counted(rows, parts)
    for t in few:
        t.prefix = t.take(counts[t.part()])


def keys_at_ranks(
    df: DataFrame, values: list[Column], text: str, ranks: list[list[int]]
) -> list[list[Key]]:
    """For each dimension the keys at its ranks, from 1, in ascending order of its value and then of
    `text`. A NULL value comes last, a NULL text first; no two rows have the same text."""
    extent = df.select(
        F.count(F.lit(1)),
        F.array(*[F.min(v) for v in values]),
        F.array(*[F.max(v) for v in values]),
    ).first()
    lows = [low or 0 for low in extent[1]]
    ends = [0 if high is None else high + 1 for high in extent[2]]  # where NULLs are counted
    rows = df.select(
        F.array(
            *[F.coalesce(v, F.lit(e).cast("bigint")) for v, e in zip(values, ends, strict=True)]
        ).alias("values"),
        F.col(text).alias("text"),
    )
    targets = [
        _Target(d, rank, lows[d], (ends[d] - lows[d]).bit_length(), rows=extent[0])
        for d, own in enumerate(ranks)
        for rank in own
    ]
    wrong = [t.rank for t in targets if not 1 <= t.rank <= extent[0]]
    if wrong:
        raise ValueError(f"no ranks {wrong} among {extent[0]} rows")
    _narrow_numbers(rows, targets)
    _narrow_texts(rows, targets)
    found = iter((None if t.low == ends[t.dimension] else t.low, t.prefix) for t in targets)
    return [[next(found) for _ in own] for own in ranks]
