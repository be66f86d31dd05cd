"""Rows of equal keys, met one after another in range-partitioned and sorted order.

A key with a large share of all rows spreads over many partitions, as the document takes part in
the order. Each partition is streamed with constant memory: a row can be judged as soon as enough
documents of its key were seen. Only of the key that a partition begins or ends with, the rows of
one document, or of fewer than enough, may depend on its neighbours; they are marked, and settled
by summaries of at most two keys for each partition. Where a few documents have a key very often,
so that `MOST_WAITING` rows wait for others, these are marked and settled in the same way.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LONG = np.int64
MOST_WAITING = 1 << 18
MOST_BROADCAST = 200_000
# Partitions that a task streams one after another into one file, once all cores have tasks. They are
# sized for the sort, and many for little text if the session has many; each file costs processes, too,
# where its permissions are set by a command.
PARTITIONS_PER_FILE = 8


class _Run:
    """The key that a partition's last rows so far have."""

    def __init__(self, k1, k2, docs: np.ndarray, opens: bool):
        self.key, self.first, self.last = (k1, k2), docs[0], docs[-1]
        self.docs = 1 + int((docs[1:] != docs[:-1]).sum())
        self.opens = opens  # the partition begins with it, so earlier ones may have rows of it
        self.marked = False  # rows of it went out before enough documents were seen

    def add(self, docs: np.ndarray) -> None:
        self.docs += int((docs[1:] != docs[:-1]).sum()) + int(docs[0] != self.last)
        self.last = docs[-1]


class _Stream:
    """Judges the rows of one partition, batch by batch."""

    def __init__(self, payload: list[str], least: int, most_waiting: int):
        self.payload, self.least, self.most_waiting = payload, least, most_waiting
        self.run: _Run | None = None
        # Rows of `run` that wait for more documents; fewer than `least` have any here.
        self.held: list[pd.DataFrame] = []

    def _found(self, rows: pd.DataFrame, later, is_open: bool) -> pd.DataFrame:
        out = rows[["_k1", "_k2", "_doc", *self.payload]]
        return out.assign(_later=later, _open=is_open, _docs=_LONG(0), _last=_LONG(0))

    def _summary(self) -> pd.DataFrame:
        run = self.run
        values = {"_k1": run.key[0], "_k2": run.key[1], "_doc": run.first}
        values |= dict.fromkeys(self.payload, 0) | {"_later": False, "_open": True}
        return pd.DataFrame([values | {"_docs": run.docs, "_last": run.last}])

    def _take(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows of the run, after it has counted them."""
        run = self.run
        of_first = rows["_doc"] == run.first
        if run.opens and of_first.any():  # the key's first document, unless it began earlier
            yield self._found(rows[of_first], False, True)
            rows = rows[~of_first]
        if run.docs < self.least:
            self.held.append(rows)
            if sum(map(len, self.held)) > self.most_waiting:
                run.marked = True
                yield from self._wait()
            return
        for waiting in (*self.held, rows):
            if len(waiting):
                yield self._found(waiting, waiting["_doc"] != run.first, False)
        self.held = []

    def _wait(self) -> Iterator[pd.DataFrame]:
        """The held rows, to be settled by the summary of their key."""
        for waiting in self.held:
            if len(waiting):
                yield self._found(waiting, waiting["_doc"] != self.run.first, True)
        self.held = []

    def _end(self, is_last: bool) -> Iterator[pd.DataFrame]:
        if self.run is not None and (self.run.opens or self.run.marked or is_last):
            yield self._summary()
            yield from self._wait()
        self.run, self.held = None, []

    def _batch(self, batch: pd.DataFrame, is_first: bool) -> Iterator[pd.DataFrame]:
        k1, k2, doc = (batch[c].to_numpy(_LONG) for c in ("_k1", "_k2", "_doc"))
        begins = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(batch))
        first, last = slice(0, ends[0]), slice(starts[-1], ends[-1])
        if self.run is not None and self.run.key == (k1[0], k2[0]):
            self.run.add(doc[first])
            yield from self._take(batch[first])
            inner = 1
        elif is_first:
            self.run = _Run(k1[0], k2[0], doc[first], True)
            yield from self._take(batch[first])
            inner = 1
        else:
            inner = 0
        if inner == len(starts):
            return
        yield from self._end(False)
        new_doc = begins | np.concatenate([[True], doc[1:] != doc[:-1]])
        enough = np.add.reduceat(new_doc.astype(_LONG), starts) >= self.least
        enough[:inner] = enough[-1] = False  # the last one may go on
        chosen = np.repeat(enough, ends - starts)
        if chosen.any():
            later = doc != np.repeat(doc[starts], ends - starts)
            yield self._found(batch[chosen], later[chosen], False)
        self.run = _Run(k1[last.start], k2[last.start], doc[last], False)
        yield from self._take(batch[last])

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        is_first = True
        for batch in batches:
            if len(batch):
                yield from self._batch(batch, is_first)
                is_first = False
        yield from self._end(True)


def shared_rows(
    rows: DataFrame,
    payload: list[str],
    least: int,
    descending: bool,
    partitions: int,
    write,
    most_waiting: int = MOST_WAITING,
) -> DataFrame:
    """The rows whose key (`_k1`, `_k2`) occurs in at least `least` different documents (`_doc`),
    with `_later`: whether the document is another than the first of these, in ascending or
    descending order.

    All columns are bigint and without nulls; `payload` names those besides key and document.
    `write` puts a table into the shared folder. One exchange, of these narrow rows.
    """
    columns = ["_k1", "_k2", "_doc", *payload]
    order: list[Column] = [
        F.col("_k1"),
        F.col("_k2"),
        F.desc("_doc") if descending else F.asc("_doc"),
        *[F.col(c) for c in payload],
    ]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    files = max(-(-partitions // PARTITIONS_PER_FILE), min(partitions, 2 * cores))
    schema = ", ".join(f"{c} bigint" for c in [*columns, "_docs", "_last"])
    names = [*columns, "_docs", "_last", "_later", "_open"]
    streamed = write(
        rows.select(*columns)
        .repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .mapInPandas(
            lambda batches: (out[names] for out in _Stream(payload, least, most_waiting)(batches)),
            f"{schema}, _later boolean, _open boolean",
        )
        .coalesce(files)
    )
    settled = _settle(streamed.where("_docs > 0"), least, descending)
    judged = streamed.where("_docs = 0 AND NOT _open").select(*columns, "_later")
    waiting = streamed.where("_docs = 0 AND _open").select(*columns)
    found = waiting.join(settled, ["_k1", "_k2"])
    return judged.unionByName(
        found.select(*columns, (F.col("_doc") != F.col("_first")).alias("_later"))
    )


def _settle(summaries: DataFrame, least: int, descending: bool) -> DataFrame:
    """Keys cut by partition borders that have enough documents after all, and their first."""
    spark = summaries.sparkSession
    found = summaries.select("_k1", "_k2", F.col("_doc").alias("_first"), "_last", "_docs")
    found = found.toPandas().astype(_LONG)
    found = found.sort_values(
        ["_k1", "_k2", "_first", "_last"], ascending=[True, True, not descending, not descending]
    )
    same_key = (found["_k1"] == found["_k1"].shift()) & (found["_k2"] == found["_k2"].shift())
    # A document that goes on over a border was counted on either side.
    found["_docs"] -= (same_key & (found["_first"] == found["_last"].shift())).astype(_LONG)
    totals = found.groupby(["_k1", "_k2"], as_index=False).agg(
        _first=("_first", "first"), _docs=("_docs", "sum")
    )
    totals = totals[totals["_docs"] >= least]
    # Of Arrow columns, as Spark converts a list of rows in Python workers of their own.
    settled = spark.createDataFrame(
        pa.table({c: totals[c].to_numpy(_LONG) for c in ("_k1", "_k2", "_first")}),
        "_k1 bigint, _k2 bigint, _first bigint",
    )
    return F.broadcast(settled) if len(totals) <= MOST_BROADCAST else settled
