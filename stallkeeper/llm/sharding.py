"""Shards of near equal bytes, by histogram sort.

Rows are ordered by a key. A splitter is the key at which a given share of all bytes lies below.
To find the splitters, exact bytes and rows between candidate boundaries are counted over all
partitions; the intervals that hold a splitter are divided again until the bytes in them are
within tolerance. Then the rows are exchanged once, each to the interval it lies in.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm.scratch import written

KEY_BITS = 63
# The low bits of the key come from the row, the high ones from its text: equal texts lie side by
# side, in one shard unless a splitter has to go through them, and many of them still divide.
ROW_BITS = 31
FIRST_BITS, NEXT_BITS = 11, 6
# A splitter may be off by this share of a shard's bytes, and then by no more than one row.
TOLERANCE = 0.001
# Intervals beyond these rows are divided, too, so that no task gets one large group.
LEAST_INTERVAL_ROWS = 1000
MOST_INTERVALS = 4096


@dataclass
class Intervals:
    """Adjoining half-open intervals of keys, with exact counts."""

    starts: np.ndarray
    bits: np.ndarray
    rows: np.ndarray
    bytes: np.ndarray

    def divide(self, chosen: np.ndarray, counted: pd.DataFrame) -> "Intervals":
        """The chosen intervals replaced by their parts; parts without rows are left out."""
        keep = ~chosen
        bits = counted["bits"].to_numpy(np.int64)
        columns = [
            np.concatenate([old[keep], new])
            for old, new in (
                (self.starts, counted["start"].to_numpy(np.int64)),
                (self.bits, bits),
                (self.rows, counted["n_rows"].to_numpy(np.int64)),
                (self.bytes, counted["n_bytes"].to_numpy(np.int64)),
            )
        ]
        order = np.argsort(columns[0], kind="stable")
        return Intervals(*(c[order] for c in columns))


def _count(keyed: DataFrame, intervals: Intervals | None) -> pd.DataFrame:
    """Exact rows and bytes in every part of the given intervals that has any."""
    if intervals is None:
        starts, ends, bits = np.array([0]), np.array([(1 << KEY_BITS) - 1]), np.array([KEY_BITS])
        step = FIRST_BITS
    else:
        starts, bits, step = intervals.starts, intervals.bits, NEXT_BITS
        ends = starts + ((np.int64(1) << bits) - 1)

    def partial(batches):
        for batch in batches:
            keys = batch["_key"].to_numpy(np.int64)
            at = np.searchsorted(starts, keys, "right") - 1
            inside = (at >= 0) & (keys <= ends[np.maximum(at, 0)])
            keys, at = keys[inside], at[inside]
            part_bits = np.maximum(bits[at] - step, 0)
            parts = pd.DataFrame(
                {
                    "start": (keys >> part_bits) << part_bits,
                    "bits": part_bits,
                    "n_rows": np.ones(len(keys), np.int64),
                    "n_bytes": batch["_size"].to_numpy(np.int64)[inside],
                }
            )
            yield parts.groupby(["start", "bits"], as_index=False).sum()

    schema = "start bigint, bits bigint, n_rows bigint, n_bytes bigint"
    return (
        keyed.select("_key", "_size")
        .mapInPandas(partial, schema)
        .groupBy("start", "bits")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
        .toPandas()
    )


def _splitters(intervals: Intervals, shards: int) -> np.ndarray:
    """For each shard but the first, the index of the interval it begins with."""
    below = np.concatenate([[0], np.cumsum(intervals.bytes)])
    wanted = below[-1] * np.arange(1, shards) / shards
    after = np.searchsorted(below, wanted)
    before = np.maximum(after - 1, 0)
    return np.where(wanted - below[before] <= below[after] - wanted, before, after)


def _open(intervals: Intervals, shards: int) -> np.ndarray:
    total = intervals.bytes.sum()
    below = np.cumsum(intervals.bytes) - intervals.bytes
    wanted = total * np.arange(1, shards) / shards
    holds_splitter = np.searchsorted(wanted, below, "right") < np.searchsorted(
        wanted, below + intervals.bytes, "left"
    )
    most_rows = max(LEAST_INTERVAL_ROWS, int(intervals.rows.sum()) // MOST_INTERVALS)
    return (
        (intervals.bits > 0)
        & (intervals.rows > 1)
        & (
            holds_splitter & (intervals.bytes > TOLERANCE * total / shards)
            | (intervals.rows > most_rows)
        )
    )


def shard_by_bytes(docs: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """All rows and columns of `docs` with `shard_size` (UTF-8 bytes of the text, null none, plus
    8), `shard` (0 to shards - 1) and `shard_slot` (0, 1, ... without gaps in each shard).

    Bytes differ between shards by the tolerance and the size of a row at most. Repeated rows each
    take a slot of their own; null ids and texts take part like any other value. Shards stay empty
    where there are fewer rows than shards, and all do for an empty table. Other columns may have
    any name, as they travel in a struct; those with the names of the three new ones are replaced.

    The driver gets counts of intervals, whose number is bounded by the parameters above.
    """
    added = ("shard_size", "shard", "shard_slot")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    whole_text = F.struct(F.col(text).isNull(), F.col(text))
    tag = F.monotonically_increasing_id()
    # The tag tells repeated rows apart. It is written with the key, so later reads agree on it.
    keyed = written(
        docs.select(
            row.alias("row"),
            (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(8))
            .cast("bigint")
            .alias("_size"),
            F.shiftleft(
                F.shiftrightunsigned(F.xxhash64(whole_text), 64 - KEY_BITS + ROW_BITS), ROW_BITS
            ).alias("_high"),
            tag.alias("_tag"),
        ).select(
            "row",
            "_size",
            F.col("_high")
            .bitwiseOR(F.shiftrightunsigned(F.xxhash64("_tag"), 64 - ROW_BITS))
            .alias("_key"),
            "_tag",
        ),
        "keyed",
    )
    counted = _count(keyed, None)
    intervals = Intervals(*(np.empty(0, np.int64),) * 4).divide(np.empty(0, bool), counted)
    while (chosen := _open(intervals, shards)).any():
        refined = Intervals(
            intervals.starts[chosen],
            intervals.bits[chosen],
            intervals.rows[chosen],
            intervals.bytes[chosen],
        )
        intervals = intervals.divide(chosen, _count(keyed, refined))

    firsts = _splitters(intervals, shards)
    shard = np.searchsorted(firsts, np.arange(len(intervals.starts)), "right")
    rows_before = np.cumsum(intervals.rows) - intervals.rows
    first_of_shard = np.searchsorted(shard, shard, "left")
    slots_before = rows_before - rows_before[first_of_shard]
    starts = intervals.starts

    @F.pandas_udf("interval bigint, shard int, before bigint")
    def place(keys: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(starts, keys.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"interval": at, "shard": shard[at], "before": slots_before[at]})

    placed = keyed.withColumn("_place", place("_key")).withColumn(
        "_interval", F.col("_place.interval")
    )
    # Exchanged once, by interval: the rows of each are counted and bounded.
    in_order = Window.partitionBy("_interval").orderBy("_key", "_tag")
    return placed.select(
        "row.*",
        F.col("_size").alias("shard_size"),
        F.col("_place.shard").alias("shard"),
        (F.col("_place.before") + F.row_number().over(in_order) - 1).cast("bigint").alias("shard_slot"),
    )
