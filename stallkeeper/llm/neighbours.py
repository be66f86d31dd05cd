"""Approximate nearest neighbours from balanced posting lists.

Centroids come from a bounded sample, halved again and again into parts of equal size, so the lists
of all vectors are near equal. A vector near a border between lists is entered in several: in every
list whose centroid is nearly as near as the nearest one, unless a centroid already chosen is
nearer to that one than the vector is. Centroids are found by walking a graph of their neighbours,
held in memory. A query reads the lists whose centroid is within a ratio of the nearest one's
distance (or of the usual distance from a vector to its centroid, if that is more), and as many as
hold enough rows for a result; it measures the vectors in them exactly.

Lists are stored as blocks of a bounded number of vectors, queries as blocks, too; a block of one
meets a block of the other in a join on the list, so that no task depends on how large a list or
how frequent a vector is. Of equal vectors, only as many of the lowest ids as can be in a result
are kept: the others could not be, by the rule on ties.

Rows without an id, and vectors that are null, zero, hold null or non-finite components, or have
another length than that of the lowest id, take no part. Rows that agree in id and vector are one.
Of several vectors of one id, each is a query and a candidate of its own; a query leaves out only
its own row. Fewer candidates than asked for give shorter results. Extra columns may have any name.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm.scratch import LARGE_ROWS, written
from stallkeeper.llm.vectors import as_matrix, dimensions, is_finite

# Vectors of a list, on average and before replication, up to MOST_LISTS lists.
LIST_SIZE = 200
MOST_LISTS = 8192
# Rows that the centroids are fitted on, four for each list at most.
SAMPLE = 32_768
# A vector is entered in at most so many lists, none farther than (1 + NEAR) times the nearest.
REPLICAS, NEAR = 2, 0.02
# A query reads the lists up to (1 + REACH) times that distance.
REACH = 0.2
# Neighbours of a centroid in the graph, and centroids that a walk holds at least.
DEGREE, WIDTH = 16, 24
LIST_BLOCK, QUERY_BLOCK, WALK_BLOCK = 1024, 256, 256


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def _balanced(sample: np.ndarray, lists: int) -> list[np.ndarray]:
    """Means of as many parts of equal size, neighbours side by side."""
    if lists <= 1 or len(sample) < 2:
        return [sample.mean(axis=0)]
    middle = sample.mean(axis=0)
    one = sample[((sample - middle) ** 2).sum(axis=1).argmax()]
    two = sample[((sample - one) ** 2).sum(axis=1).argmax()]
    upper = lists // 2
    border = len(sample) - max(1, len(sample) * upper // lists)
    for _ in range(8):
        order = np.argsort(sample @ (two - one), kind="stable")
        lower_half, upper_half = sample[order[:border]], sample[order[border:]]
        one, two = lower_half.mean(axis=0), upper_half.mean(axis=0)
    return _balanced(lower_half, lists - upper) + _balanced(upper_half, upper)


@dataclass
class Graph:
    """Centroids and, for each, neighbours to walk to, -1 where there are fewer; and the usual
    distance from a vector to its centroid."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray
    usual: float

    def within(self, vectors: np.ndarray, ratio: float, usual: float = 0.0) -> np.ndarray:
        """Distances to the centroids that a walk met, infinite to the others. It goes on from
        every centroid within (1 + ratio) times the distance of the nearest one, or `usual`, or
        among the nearest WIDTH."""
        count = len(self.centroids)
        met = np.full((len(vectors), count), np.inf)
        met[:, self.entries] = _distances(vectors, self.centroids[self.entries])
        left = np.zeros(met.shape, bool)
        while True:
            limit = np.maximum(met.min(axis=1), usual) * (1 + ratio)
            if count > WIDTH:
                limit = np.maximum(limit, np.partition(met, WIDTH - 1, axis=1)[:, WIDTH - 1])
            at, node = np.nonzero((met <= limit[:, None]) & np.isfinite(met) & ~left)
            if not len(at):
                return met
            left[at, node] = True
            to = self.neighbours[node]
            at = np.broadcast_to(at[:, None], to.shape)[to >= 0]
            to = to[to >= 0]
            new = np.isinf(met[at, to])
            pairs = np.unique(at[new] * count + to[new])
            at, to = np.divmod(pairs, count)
            for start in range(0, len(at), 1 << 16):
                some = slice(start, start + (1 << 16))
                apart = vectors[at[some]] - self.centroids[to[some]]
                met[at[some], to[some]] = np.sqrt((apart * apart).sum(axis=1))

    def lists_of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of vectors and the lists they are entered in."""
        met = self.within(vectors, NEAR)
        order = np.argsort(met, axis=1, kind="stable")[:, : 4 * REPLICAS]
        far = np.take_along_axis(met, order, axis=1)
        near = far <= far[:, :1] * (1 + NEAR)
        places, lists = [], []
        for i in range(len(vectors)):
            chosen: list[int] = []
            for c, d in zip(order[i][near[i]], far[i][near[i]], strict=True):
                between = self.centroids[chosen] - self.centroids[c]
                if not chosen or (np.sqrt((between * between).sum(axis=1)) >= d).all():
                    chosen.append(c)
                if len(chosen) == REPLICAS:
                    break
            places += [i] * len(chosen)
            lists += chosen
        return np.array(places, np.int64), np.array(lists, np.int64)

    def lists_for(
        self, queries: np.ndarray, rows: np.ndarray, least: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and the lists they read. `rows` are those of each list, of which the
        nearest `least` are read, however far."""
        met = self.within(queries, REACH, self.usual)
        few = (np.isfinite(met) * rows).sum(axis=1) < least
        met[few] = _distances(queries[few], self.centroids)
        order = np.argsort(met, axis=1, kind="stable")
        before = np.cumsum(rows[order], axis=1) - rows[order]
        needed = np.zeros(met.shape, bool)
        np.put_along_axis(needed, order, before < least, axis=1)
        limit = np.maximum(met.min(axis=1), self.usual)[:, None] * (1 + REACH)
        return np.nonzero(np.isfinite(met) & (needed | (met <= limit)))


@dataclass
class Index:
    """`blocks` are the lists; `rows` is how many each of them holds."""

    graph: Graph | None
    blocks: DataFrame | None
    rows: np.ndarray | None
    size: int


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
    )
    return rows.where(
        F.col("vec_id").isNotNull() & is_finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    )


def _fit(rows: DataFrame, size: int) -> Graph | None:
    """Centroids of the sample, and the graph; its neighbours are found in tasks."""
    total = rows.count()
    if not total:
        return None
    lists = min(MOST_LISTS, -(-total // LIST_SIZE))
    wanted = min(SAMPLE, 4 * LIST_SIZE * lists)
    # By a hash of the row, so that the same rows are drawn again.
    drawn = F.shiftrightunsigned(F.xxhash64("vec_id", "v"), 11) < int((1 << 53) * wanted / total)
    sample = rows.where(drawn).select("v").limit(2 * SAMPLE).toArrow().column("v")
    sample = as_matrix(sample.combine_chunks(), size) if len(sample) else np.zeros((0, size))
    if not len(sample):
        sample = np.array(rows.select("v").first()[0])[None]
    sample = np.unique(sample, axis=0)
    centroids = np.array(_balanced(sample, min(lists, len(sample))))
    nearest = [
        _distances(sample[at : at + 1024], centroids).min(axis=1)
        for at in range(0, len(sample), 1024)
    ]
    return _graph(rows, centroids, float(np.median(np.concatenate(nearest))))


def _graph(rows: DataFrame, centroids: np.ndarray, usual: float) -> Graph:
    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            far = _distances(centroids[own], centroids)
            found = []
            for row, of in zip(far, own, strict=True):
                row[of] = np.inf
                kept: list[int] = []
                for c in np.argsort(row, kind="stable")[: min(3 * DEGREE, len(row) - 1)]:
                    apart = centroids[kept] - centroids[c]
                    if not kept or (np.sqrt((apart * apart).sum(axis=1)) > row[c]).all():
                        kept.append(int(c))
                    if len(kept) == DEGREE:
                        break
                found.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "to"]
            )

    count = len(centroids)
    spark = rows.sparkSession
    links: list[set[int]] = [set() for _ in range(count)]
    for of, to in spark.range(count).mapInArrow(neighbours, "id bigint, to array<bigint>").collect():
        for other in to:
            links[of].add(other)
            links[other].add(of)
    for of in range(count - 1):  # side by side when halved, so that no part is cut off
        links[of].add(of + 1)
        links[of + 1].add(of)
    table = np.full((count, max(1, *(len(x) for x in links)) if count > 1 else 1), -1)
    for of, to in enumerate(links):
        table[of, : len(to)] = sorted(to)
    entries = np.unique(np.linspace(0, count - 1, 16).astype(np.int64))
    return Graph(centroids, table, entries, usual)


def _in_lists(rows: DataFrame, size: int, choose) -> DataFrame:
    """`list`, `vec_id` and `v` for every list that `choose` gives a row."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), WALK_BLOCK):
                part = batch.slice(start, WALK_BLOCK)
                places, lists = choose(as_matrix(part.column("v"), size))
                part = part.take(pa.array(places))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists), *part.columns], names=["list", "vec_id", "v"]
                )

    return rows.select("vec_id", "v").mapInArrow(
        walk, "list bigint, vec_id bigint, v array<double>"
    )


def _with_block(rows: DataFrame, block_size: int, salt: Column) -> DataFrame:
    """Rows with a `block` of their list; equal salts share a block."""
    blocks = rows.groupBy("list").agg(F.ceil(F.count("*") / block_size).alias("_blocks"))
    # One row for each list, MOST_LISTS at most.
    return rows.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(salt, F.col("_blocks")))


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each block: its columns, each as one array."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        arrays = {c: table.column(c).chunk(0) for c in columns}
        arrays = {c: a.flatten() if pa.types.is_list(a.type) else a for c, a in arrays.items()}
        return pa.table(
            {"list": table.column("list").slice(0, 1), **{c: _one(a) for c, a in arrays.items()}}
        )

    kinds = dict(rows.dtypes)
    schema = ", ".join(
        f"{c} {kinds[c] if kinds[c].startswith('array') else f'array<{kinds[c]}>'}" for c in columns
    )
    rows = rows.select("list", "block", *columns)
    return rows.groupBy("list", "block").applyInArrow(pack, f"list bigint, {schema}")


def build(
    vectors: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding"
) -> Index:
    """Posting lists of all vectors that take part, for results of up to `k` rows."""
    rows = _usable(vectors, vec_id, vector)
    size = dimensions(rows, "vec_id", "v")
    rows = rows.where(F.size("v") == size)
    graph = _fit(rows, size)
    if graph is None:
        return Index(None, None, None, 0)
    entered = written(_in_lists(rows, size, graph.lists_of), "ann-entries")
    entered = _with_block(entered, LIST_BLOCK, F.xxhash64("v"))
    lowest = Window.partitionBy("list", "block", "v").orderBy("vec_id")
    entered = entered.withColumn("_nth", F.dense_rank().over(lowest)).where(F.col("_nth") <= k + 1)
    blocks = written(_packed(entered, ["vec_id", "v"]), "ann-lists", LARGE_ROWS)
    held = np.zeros(len(graph.centroids), np.int64)
    for row in blocks.groupBy("list").agg(F.sum(F.size("vec_id")).alias("n")).collect():
        held[row.list] = row.n
    return Index(graph, blocks, held, size)


def _nearest(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, near: np.ndarray, k: int):
    """The k + 1 nearest rows of a block: ids and exact distances. `near` is the distance as a
    matrix product gives it; what it may be off by is left in."""
    if len(near) > k + 1:
        limit = np.partition(near, k)[k]
        chosen = np.flatnonzero(near <= limit * (1 + 1e-6) + 1e-6 * np.sqrt((query * query).sum()))
    else:
        chosen = np.arange(len(near))
    apart = vectors[chosen] - query
    exact = np.sqrt((apart * apart).sum(axis=1))
    order = np.lexsort((ids[chosen], exact))
    found, scores = ids[chosen][order], exact[order]
    # Copies of one row side by side, after replication within a task.
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (scores[1:] != scores[:-1])
    return found[new][: k + 1], scores[new][: k + 1]


def _merged(columns: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of rows found in several lists, each query's k + 1 nearest, and each of them once."""
    query, which, ids, scores = columns
    order = np.lexsort((ids, scores, which, query))
    query, which, ids, scores = (c[order] for c in columns)
    same = np.zeros(len(ids), bool)
    same[1:] = (query[1:] == query[:-1]) & (which[1:] == which[:-1])
    again = same.copy()
    again[1:] &= (ids[1:] == ids[:-1]) & (scores[1:] == scores[:-1])
    query, which, ids, scores, same = (c[~again] for c in (query, which, ids, scores, same))
    starts = np.flatnonzero(~same)
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    return [c[place <= k] for c in (query, which, ids, scores)]


def search(
    index: Index,
    queries: DataFrame,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """`query_id`, `rank` from 1, `vec_id` and `score`, the Euclidean distance, of the k nearest
    rows found, nearest first, equal ones by id; without the query's own row."""
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = _usable(queries, vec_id, vector).where(F.size("v") == index.size).distinct()
    if index.graph is None:
        return rows.sparkSession.createDataFrame([], schema)
    graph, held = index.graph, index.rows
    least = REPLICAS * (k + 1)  # a row is in REPLICAS lists at most

    def choose(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return graph.lists_for(vectors, held, least)

    visits = written(_in_lists(rows, index.size, choose), "ann-visits")
    visits = _with_block(visits, QUERY_BLOCK, F.xxhash64("vec_id", "v"))
    visits = visits.withColumn("which", F.xxhash64("v"))
    visits = _packed(visits, ["vec_id", "which", "v"]).withColumnsRenamed(
        {"vec_id": "query_id", "v": "q"}
    )
    size = index.size

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(len(batch)):
                row = {n: batch.column(n)[i].values.to_numpy() for n in batch.schema.names}
                listed, asked = row["v"].reshape(-1, size), row["q"].reshape(-1, size)
                near = _distances(asked, listed)
                for j, q in enumerate(asked):
                    ids, scores = _nearest(row["vec_id"], listed, q, near[j], k)
                    query = np.full((2, len(ids)), [[row["query_id"][j]], [row["which"][j]]])
                    found.append((*query, ids, scores))
            if found:
                columns = _merged([np.concatenate(c) for c in zip(*found, strict=True)], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["query_id", "which", "vec_id", "score"]
                )

    met = index.blocks.join(visits, "list").select("query_id", "which", "q", "vec_id", "v")
    met = met.mapInArrow(measure, "query_id bigint, which bigint, vec_id bigint, score double")
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)
    best = Window.partitionBy("query_id", "which").orderBy("score", "vec_id")
    return (
        met.where(~own)
        .distinct()
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
