"""Ranked lexical search by a length-stratified index.

A document's length enters its score only through the normaliser m, a whole number. The index
groups documents of equal m into strata, and large strata into blocks of a bounded number of
postings. In a block, a term's postings are ordered by their number of occurrences (tf), so the
first one gives the highest score that the term can add there, and an impact is computed once for
each tf. The sum of these highest impacts bounds what any document of the block can score.

Searching visits the blocks of the highest bounds first; the k-th best score found there is a
threshold below which other blocks need no visit. The result is exact.

A row of documents is a document of its own: repeated rows are ranked as often as they occur.
Null and empty texts have no terms and are neither counted nor found; a null id comes last among
equal scores. Rows of items that agree in id and text are one item; items of one id and several
texts are ranked separately. Only the named columns are read, so others may have any name.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm.scratch import LARGE_ROWS, written

# Terms are what stands between these bytes, A-Z in lower case. Bytes of characters
# beyond ASCII are all above 0x7F.
_TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
    for c in range(256)
)
# Postings in a block of the index, on average; documents are dealt to the blocks of a stratum.
BLOCK_POSTINGS = 250_000
# Blocks that an item visits before its threshold is known.
FIRST_VISITS = 16
# Items are searched in passes of at most so many different (item, term) pairs, or of one item.
PASS_TERMS = 200_000
# Strata of more than one block are broadcast up to so many, beyond that they are joined by shuffle.
MOST_LARGE_STRATA = 100_000
_COMPACT = {"compression": "zstd"}
# Sums of whole numbers below this are exact as doubles.
_EXACT = float(1 << 53)


def _terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, `n` (terms with repeats), `terms` and `tfs` for each row that has a term. Terms are
    one text, with a blank after each."""
    kind = df.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(1), pa.binary())
            keep, ns, terms, ends, tfs = [], [], [], [0], []
            for i in range(len(texts)):
                words = (texts[i].as_py() or b"").translate(_TERM_BYTES).split()
                if words:
                    counted = Counter(words)
                    keep.append(i)
                    ns.append(len(words))
                    terms.append(b" ".join(counted) + b" ")
                    tfs.extend(counted.values())
                    ends.append(len(tfs))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    pa.array(ns, pa.int64()),
                    pa.array(terms, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tfs, pa.int32())),
                ],
                names=[key, "n", "terms", "tfs"],
            )

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(
        count, f"`{key}` {kind}, n bigint, terms binary, tfs array<int>"
    )


def _split(terms: bytes) -> pa.Array:
    """The single terms, each with its blank, without a copy."""
    data = np.frombuffer(terms, np.uint8)
    ends = np.flatnonzero(data == ord(" ")) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), len(ends), buffers)


@dataclass
class Index:
    """`blocks` has one row for each block: `m`, `block`, the block's `doc_ids`, its `terms`, the
    `ends` of their postings, and these as `slots` (places in `doc_ids`) and `tfs`."""

    blocks: DataFrame
    documents: int


def _pack(table: pa.Table) -> pa.Table:
    """Documents of one block, turned into postings."""
    table = table.combine_chunks()
    own_tfs = table.column("tfs").chunk(0)
    slots = np.repeat(np.arange(len(own_tfs), dtype=np.int32), np.diff(own_tfs.offsets.to_numpy()))
    tfs = own_tfs.flatten().to_numpy()
    coded = _split(b"".join(table.column("terms").to_pylist())).dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.lexsort((-tfs, codes))
    ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary))).astype(np.int32)

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.table(
        {
            "m": table.column("m").slice(0, 1),
            "block": table.column("block").slice(0, 1),
            "doc_ids": one(table.column("doc_id").chunk(0)),
            "terms": pa.array([b"".join(coded.dictionary.to_pylist())], pa.binary()),
            "ends": one(pa.array(ends)),
            "slots": one(pa.array(slots[order])),
            "tfs": one(pa.array(tfs[order])),
        }
    )


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of every term of every document, written to the shared folder."""
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    counted = written(
        _terms(given, "doc_id", "text").withColumn("_row", F.monotonically_increasing_id()),
        "lexical-terms",
        _COMPACT,
    )
    documents, terms = counted.agg(F.count("n"), F.sum("n")).first()
    m = F.expr(f"25 + cast(75 * cast(n AS decimal(20, 0)) * {documents} div {terms or 1} AS bigint)")
    counted = counted.withColumn("m", m)
    large = counted.groupBy("m").agg(
        F.ceil(F.sum(F.size("tfs")) / BLOCK_POSTINGS).cast("int").alias("_blocks")
    )
    large = written(large.where("_blocks > 1"), "lexical-strata")
    if large.count() <= MOST_LARGE_STRATA:
        large = F.broadcast(large)
    block = F.coalesce(F.col("_row") % F.col("_blocks"), F.lit(0)).cast("int")
    placed = counted.join(large, "m", "left").select(
        "m", block.alias("block"), "doc_id", "terms", "tfs"
    )
    blocks = placed.groupBy("m", "block").applyInArrow(
        _pack,
        "m bigint, block int, doc_ids array<bigint>, terms binary, ends array<int>, "
        "slots array<int>, tfs array<int>",
    )
    return Index(written(blocks, "lexical-index", LARGE_ROWS | _COMPACT), documents)


class _Items:
    """Items of one pass: for each, the places of its terms in the vocabulary and their repeats."""

    def __init__(self, rows: list):
        self.ids = [row["item_id"] for row in rows]
        coded = _split(b"".join(bytes(row["terms"]) for row in rows)).dictionary_encode()
        self.vocabulary = coded.dictionary
        self.terms = coded.indices.to_numpy().astype(np.int64)
        self.repeats = np.array([q for row in rows for q in row["tfs"]], np.int64)
        self.starts = np.cumsum([0, *(len(row["tfs"]) for row in rows)])
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def bounds(self, m: int, found: np.ndarray, highest: np.ndarray) -> np.ndarray:
        """For each item, what no document can exceed that has each term `highest` times."""
        best = np.zeros(len(self.weights))
        best[found] = self.weights[found] * _impact(highest, m)
        return np.add.reduceat(self.repeats * best[self.terms], self.starts[:-1])


def _impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class _Block:
    """One row of the index as far as the vocabulary of a pass goes."""

    def __init__(self, row: dict[str, pa.Array], i: int, places: np.ndarray):
        self.m = row["m"][i].as_py()
        ends = row["ends"][i].values.to_numpy()
        starts = np.concatenate([[0], ends[:-1]])
        own = np.flatnonzero(places >= 0)
        self.found = places[own]
        self.starts, self.ends = starts[own], ends[own]
        self.tfs = row["tfs"][i].values.to_numpy()
        self.slots = row["slots"][i].values.to_numpy()
        self.doc_ids = row["doc_ids"][i].values
        self.run: np.ndarray | None = None

    @property
    def highest(self) -> np.ndarray:
        return self.tfs[self.starts]

    def _prepare(self, items: _Items) -> None:
        """What each posting of a term of the pass adds, side by side by term."""
        lengths = self.ends - self.starts
        self.last = np.cumsum(lengths)
        at = np.arange(self.last[-1]) + np.repeat(self.starts - (self.last - lengths), lengths)
        different, which = np.unique(self.tfs[at], return_inverse=True)
        impacts = _impact(different, self.m)[which]  # once for each tf
        self.adds = np.repeat(items.weights[self.found], lengths) * impacts
        self.own_slots = self.slots[at]
        self.run = np.full(len(items.weights), -1)
        self.run[self.found] = np.arange(len(self.found))

    def best(self, items: _Items, item: int, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and scores of the item's k best documents here, among equals those of the lowest
        ids."""
        if self.run is None:
            self._prepare(items)
        part = slice(items.starts[item], items.starts[item + 1])
        runs = self.run[items.terms[part]]
        repeats = items.repeats[part][runs >= 0]
        runs = runs[runs >= 0]
        begin = np.where(runs > 0, self.last[runs - 1], 0)
        lengths = self.last[runs] - begin
        total = np.cumsum(lengths)
        at = np.arange(total[-1]) + np.repeat(begin - (total - lengths), lengths)
        adds = self.adds[at] * np.repeat(repeats, lengths)
        slots = self.own_slots[at]
        if bound < _EXACT:
            scores = np.bincount(slots, adds, len(self.doc_ids)).astype(np.int64)
        else:
            scores = np.zeros(len(self.doc_ids), np.int64)
            np.add.at(scores, slots, adds)
        chosen = np.flatnonzero(scores > 0)
        if len(chosen) > k:
            least = np.partition(scores[chosen], -k)[-k]
            chosen = chosen[scores[chosen] >= least]
        ids = self.doc_ids.take(pa.array(chosen))
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        order = np.lexsort((ids, missing, -scores[chosen]))[:k]
        return chosen[order], scores[chosen[order]]


def _blocks(batch: pa.RecordBatch, vocabulary: pa.Array) -> Iterator[tuple[_Block, int]]:
    row = {name: batch.column(name) for name in batch.schema.names}
    for i in range(len(batch)):
        terms = _split(row["terms"][i].as_py())
        places = pc.index_in(terms, value_set=vocabulary).fill_null(-1).to_numpy()
        block = _Block(row, i, places)
        if len(block.found):
            yield block, row["block"][i].as_py()


def _document_counts(index: Index, items: _Items) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs."""

    def count(batches):
        for batch in batches:
            total = np.zeros(len(items.weights), np.int64)
            for block, _ in _blocks(batch, items.vocabulary):
                total[block.found] += block.ends - block.starts
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(total[found])], names=["term", "df"]
            )

    counted = index.blocks.mapInArrow(count, "term bigint, df bigint")
    counts = np.zeros(len(items.weights), np.int64)
    for term, df in counted.groupBy("term").agg(F.sum("df")).collect():
        counts[term] = df
    return counts


def _first_visits(index: Index, items: _Items) -> dict[tuple[int, int], list[int]]:
    """For each item the blocks of the highest bounds, as items by block."""

    def bounds(batches):
        for batch in batches:
            for block, number in _blocks(batch, items.vocabulary):
                bound = items.bounds(block.m, block.found, block.highest)
                item = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(item),
                        pa.array(np.full(len(item), block.m)),
                        pa.array(np.full(len(item), number, np.int32)),
                        pa.array(bound[item]),
                    ],
                    names=["item", "m", "block", "bound"],
                )

    found = index.blocks.mapInArrow(bounds, "item bigint, m bigint, block int, bound double")
    best = Window.partitionBy("item").orderBy(F.desc("bound"), "m", "block")
    found = found.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= FIRST_VISITS)
    visits: dict[tuple[int, int], list[int]] = {}
    for row in found.collect():
        visits.setdefault((row.m, row.block), []).append(row.item)
    return visits


def _scored(
    index: Index, items: _Items, k: int, visits: dict, thresholds: np.ndarray | None
) -> DataFrame:
    """The k best of every visited block: `item`, `doc_id`, `score`. Without thresholds the
    `visits` are made, with them all others whose bound is not below the item's threshold."""

    def score(batches):
        least = None if thresholds is None else thresholds.copy()
        kept: dict[int, np.ndarray] = {}  # the k best scores of each item in this task
        for batch in batches:
            blocks = list(_blocks(batch, items.vocabulary))
            if not blocks:
                continue
            bounds = np.stack([items.bounds(b.m, b.found, b.highest) for b, _ in blocks])
            done = np.zeros(bounds.shape, bool)
            for i, (block, number) in enumerate(blocks):
                done[i, visits.get((block.m, number), [])] = True
            wanted = done if least is None else ~done & (bounds >= least)
            wanted &= bounds > 0
            for item in np.flatnonzero(wanted.any(axis=0)):
                order = np.flatnonzero(wanted[:, item])
                for i in order[np.argsort(-bounds[order, item], kind="stable")]:
                    if least is not None and bounds[i, item] < least[item]:
                        break
                    block = blocks[i][0]
                    slots, scores = block.best(items, item, bounds[i, item], k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(slots), item)),
                            block.doc_ids.take(pa.array(slots)),
                            pa.array(scores),
                        ],
                        names=["item", "doc_id", "score"],
                    )
                    if least is not None:
                        best = np.sort(np.append(kept.get(item, scores[:0]), scores))[-k:]
                        kept[item] = best
                        if len(best) == k:
                            least[item] = max(least[item], best[0])

    blocks = index.blocks
    if thresholds is None:
        # At most FIRST_VISITS for each item of the pass.
        chosen = blocks.sparkSession.createDataFrame(list(visits), "m bigint, block int")
        blocks = blocks.join(F.broadcast(chosen), ["m", "block"], "left_semi")
    return blocks.mapInArrow(score, "item bigint, doc_id bigint, score bigint")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(index: Index, rows: list, k: int) -> DataFrame:
    items = _Items(rows)
    counts = _document_counts(index, items)
    weights = np.floor(1000 * np.log((2 * index.documents + 2) / (2 * counts + 1)))
    items.weights = weights.astype(np.int64)
    visits = _first_visits(index, items)
    first = written(_best(_scored(index, items, k, visits, None), k), "lexical-first")
    thresholds = np.zeros(len(items.ids))
    for row in first.where(F.col("rank") == k).collect():
        thresholds[row.item] = row.score
    others = _scored(index, items, k, visits, thresholds)
    found = _best(first.select("item", "doc_id", "score").unionByName(others), k)
    names = index.blocks.sparkSession.createDataFrame(
        list(enumerate(items.ids)), "item bigint, item_id bigint"
    )
    found = found.join(F.broadcast(names), "item")  # items of one pass
    return found.select("item_id", "rank", "doc_id", "score")


def search(
    index: Index, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """`item_id`, `rank` from 1, `doc_id` and `score` of each item's k best documents, fewer if
    fewer score above 0; equal scores by ascending id."""
    given = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    rows = written(_terms(given.distinct(), "item_id", "text"), "lexical-items")
    results, part, size = [], [], 0
    for row in rows.toLocalIterator():
        if part and size + len(row["tfs"]) > PASS_TERMS:
            results.append(written(_search(index, part, k), "lexical-found"))
            part, size = [], 0
        part.append(row)
        size += len(row["tfs"])
    if part:
        results.append(_search(index, part, k))
    if not results:
        empty = "item_id bigint, rank int, doc_id bigint, score bigint"
        return rows.sparkSession.createDataFrame([], empty)
    found = results[0]
    for other in results[1:]:
        found = found.unionByName(other)
    return found
