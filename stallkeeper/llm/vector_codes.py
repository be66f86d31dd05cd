"""Vector codes of one byte a part, from codebooks learned with metric trees.

Vectors are cut into parts, and for each part position a codebook of entries is refined in rounds:
every part goes to its nearest entry, and each entry moves to the mean of its parts, rounded down.
All arithmetic that decides is in whole numbers, so the result is that of comparing every part
with every entry.

Most of these comparisons are saved. The parts of a chunk of vectors are arranged, once, in a tree
of balls: about sqrt(n) anchors are placed one after another, each at the part farthest from the
anchor that owns it, taking over parts that are nearer to it (the middle of the tree); balls of
anchors are merged in pairs up to the root, and parts within an anchor are divided in the same way
down to the leaves. A ball caches the number and the sum of its parts. In a round, a ball inherits
the entries that may own parts of the ball around it, and drops those that cannot own any of its
own; a ball with one entry left is added to that entry as a whole, without looking at its parts.

Trees are written to the shared folder and read in each round; a chunk is bounded, so is a task.
What is shuffled are the counts and sums of each task for each entry.

Rows whose vector is null, empty, or holds null or non-finite components take no part, and neither
do vectors of another length than that of the lowest id. Repeated ids and rows each have a result.
Fewer vectors than entries make smaller codebooks. Extra columns may have any name.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm.scratch import LARGE_ROWS, written
from stallkeeper.llm.vectors import as_matrix, dimensions, is_finite

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Vectors of a chunk, which has a tree for each part position.
CHUNK = 2048
# A ball of no more parts is not divided.
LEAF = 24
# Components beyond this are refused: sums of squares are held in 64 bits.
MOST_COMPONENT = 1 << 27


@dataclass
class Tree:
    """Balls of a tree, children after parents. `first` and `end` delimit a ball's parts in the
    order of the tree; `left` and `right` are its children, -1 in a leaf."""

    first: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)


def _square_distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    apart = points - to
    return np.einsum("...i,...i->...", apart, apart)


def _anchors(points: np.ndarray) -> list[np.ndarray]:
    """Places of the points that each anchor owns. Another anchor can only take a point that is
    farther from its own anchor than half the way between the two."""
    wanted = max(2, int(np.sqrt(len(points))))
    distance = np.sqrt(_square_distances(points, points[0]))
    order = np.argsort(-distance, kind="stable")
    owned, far, pivots = [order], [distance[order]], [points[0]]
    while len(owned) < wanted:
        widest = max(range(len(owned)), key=lambda a: far[a][0])
        if far[widest][0] == 0:
            break
        pivot = points[owned[widest][0]]
        taken, taken_far = [], []
        for a, between in enumerate(np.sqrt(_square_distances(np.array(pivots), pivot))):
            # Sorted by distance, so what may be taken over stands first.
            near = int(np.searchsorted(-far[a], -between / 2, "left"))
            if not near:
                continue
            own = np.sqrt(_square_distances(points[owned[a][:near]], pivot))
            moves = own < far[a][:near]
            if moves.any():
                taken.append(owned[a][:near][moves])
                taken_far.append(own[moves])
                stays = np.concatenate([~moves, np.ones(len(far[a]) - near, bool)])
                owned[a], far[a] = owned[a][stays], far[a][stays]
        places, distances = np.concatenate(taken), np.concatenate(taken_far)
        order = np.argsort(-distances, kind="stable")
        owned.append(places[order])
        far.append(distances[order])
        pivots.append(pivot)
        kept = [a for a in range(len(owned)) if len(owned[a])]
        owned, far, pivots = ([x[a] for a in kept] for x in (owned, far, pivots))
    return owned


def _arranged(points: np.ndarray, places: np.ndarray):
    """A ball over some places: its places if it is a leaf, else its two halves."""
    groups = _anchors(points[places]) if len(places) > LEAF else []
    if len(groups) < 2:
        return places
    balls = [_arranged(points, places[own]) for own in groups]
    centres = np.array([points[places[own]].mean(axis=0) for own in groups])
    sizes = np.array([len(own) for own in groups], float)
    radii = np.array(
        [
            np.sqrt(_square_distances(points[places[own]], centre).max())
            for own, centre in zip(groups, centres, strict=True)
        ]
    )
    # The two balls go together that the smallest ball holds; up to the root.
    apart = np.sqrt(_square_distances(centres[:, None], centres[None]))
    spans = np.maximum((apart + radii[:, None] + radii[None]) / 2, np.maximum.outer(radii, radii))
    np.fill_diagonal(spans, np.inf)
    for _ in range(len(balls) - 1):
        a, b = divmod(int(spans.argmin()), len(spans))
        centres[a] = (centres[a] * sizes[a] + centres[b] * sizes[b]) / (sizes[a] + sizes[b])
        sizes[a] += sizes[b]
        radii[a] = spans[a, b]
        balls[a], balls[b] = (balls[a], balls[b]), None
        spans[b], spans[:, b] = np.inf, np.inf
        alive = np.isfinite(spans[a])
        alive[a] = False
        apart = np.sqrt(_square_distances(centres[alive], centres[a]))
        own = np.maximum((apart + radii[alive] + radii[a]) / 2, np.maximum(radii[alive], radii[a]))
        spans[a, alive] = spans[alive, a] = own
        root = balls[a]
    return root


def _flattened(ball) -> tuple[np.ndarray, Tree]:
    """The places in the order of the leaves, and the balls."""
    tree, order, at = Tree(), [], 0
    waiting = [(ball, -1, "")]
    while waiting:
        ball, parent, side = waiting.pop()
        node = len(tree.first)
        if parent >= 0:
            getattr(tree, side)[parent] = node
        tree.first.append(at)
        tree.end.append(-1)
        tree.left.append(-1)
        tree.right.append(-1)
        if isinstance(ball, tuple):
            waiting += [(ball[1], node, "right"), (ball[0], node, "left")]
        else:
            order.append(ball)
            at += len(ball)
            tree.end[node] = at
    for node in reversed(range(len(tree.first))):
        if tree.end[node] < 0:
            tree.end[node] = tree.end[tree.right[node]]
    return np.concatenate(order), tree


def _tree_columns(points: np.ndarray) -> dict[str, np.ndarray]:
    """The tree of one part position of a chunk: order of its points, balls, cached sums."""
    order, tree = _flattened(_arranged(points.astype(np.float64), np.arange(len(points))))
    arranged = points[order]
    first, end = np.array(tree.first), np.array(tree.end)
    before = np.concatenate([np.zeros((1, points.shape[1]), np.int64), arranged.cumsum(axis=0)])
    sums = before[end] - before[first]
    centres = sums / (end - first)[:, None]
    radii = [
        np.sqrt(_square_distances(arranged[f:e], c).max())
        for f, e, c in zip(first, end, centres, strict=True)
    ]
    return {
        "place": order.astype(np.int32),
        "point": arranged.ravel(),
        "first": first.astype(np.int32),
        "end": end.astype(np.int32),
        "left": np.array(tree.left, np.int32),
        "right": np.array(tree.right, np.int32),
        "sum": sums.ravel(),
        "radius": np.array(radii),
    }


_TREE = {
    "place": "int", "point": "bigint", "first": "int", "end": "int", "left": "int",
    "right": "int", "sum": "bigint", "radius": "double",
}


class _Search:
    """Which entries of a codebook own which balls and points of one tree."""

    def __init__(self, tree: dict[str, np.ndarray], book: np.ndarray):
        self.tree, self.book = tree, book
        size = book.shape[1]
        self.points = tree["point"].reshape(-1, size)
        self.sums = tree["sum"].reshape(-1, size)
        self.counts = (tree["end"] - tree["first"]).astype(np.int64)
        self.owned: list[tuple[np.ndarray, np.ndarray]] = []  # balls and the entry of each
        self.single: list[tuple[np.ndarray, np.ndarray]] = []  # points of leaves, the same
        self._descend()

    def _descend(self) -> None:
        entries = self.book.astype(np.float64)
        between = np.sqrt(_square_distances(entries[:, None], entries[None]))
        nodes = np.zeros(1, np.int64)
        lists = np.ones((1, len(entries)), bool)  # the root may have parts of every entry
        while len(nodes):
            centres = self.sums[nodes] / self.counts[nodes][:, None]
            far = _square_distances(centres[:, None], entries[None])
            nearest = np.where(lists, far, np.inf).argmin(axis=1)
            least = far[np.arange(len(nodes)), nearest][:, None]
            # Nowhere in the ball is the entry as near as the one nearest to the centre. What
            # doubles may be off by is left to the exact comparison.
            reach = 2 * self.tree["radius"][nodes][:, None] * between[nearest]
            lists &= ~(far - least > reach + 1e-9 * (far + least + 1))
            whole = lists.sum(axis=1) == 1
            self.owned.append((nodes[whole], nearest[whole]))
            leaf = ~whole & (self.tree["left"][nodes] < 0)
            for node, own in zip(nodes[leaf], lists[leaf], strict=True):
                self._compare(slice(self.tree["first"][node], self.tree["end"][node]), own)
            inner = ~whole & ~leaf
            nodes, lists = nodes[inner], lists[inner]
            nodes = np.concatenate([self.tree["left"][nodes], self.tree["right"][nodes]])
            lists = np.concatenate([lists, lists])

    def _compare(self, part: slice, own: np.ndarray) -> None:
        entries = np.flatnonzero(own)
        far = _square_distances(self.points[part][:, None], self.book[entries][None])
        self.single.append((np.arange(part.start, part.stop), entries[far.argmin(axis=1)]))

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the points of each entry."""
        counts = np.zeros(len(self.book), np.int64)
        sums = np.zeros_like(self.book)
        for balls, entries in self.owned:
            np.add.at(counts, entries, self.counts[balls])
            np.add.at(sums, entries, self.sums[balls])
        for points, entries in self.single:
            np.add.at(counts, entries, 1)
            np.add.at(sums, entries, self.points[points])
        return counts, sums

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each point and the square distance to it, in the order of the chunk."""
        found = np.empty(len(self.points), np.int64)
        for balls, entries in self.owned:
            for ball, entry in zip(balls, entries, strict=True):
                found[self.tree["first"][ball] : self.tree["end"][ball]] = entry
        for points, entries in self.single:
            found[points] = entries
        far = _square_distances(self.points, self.book[found])
        at = np.empty_like(found)
        at[self.tree["place"]] = np.arange(len(found))
        return found[at], far[at]


def _chunks(vectors: DataFrame, size: int, parts: int) -> DataFrame:
    """One row for each chunk: `vec_id` and `label` of its rows, and its trees."""

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), CHUNK):
                rows = batch.slice(start, CHUNK)
                points = as_matrix(rows.column(2), size).astype(np.int64)
                trees = [_tree_columns(part) for part in np.split(points, parts, axis=1)]
                columns = [pa.array([rows.column(i).to_pylist()]) for i in range(2)]
                columns = [
                    c.cast(pa.list_(rows.column(i).type)) for i, c in enumerate(columns)
                ] + [pa.array([[t[name] for t in trees]]) for name in _TREE]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", *_TREE])

    labels = vectors.schema["label"].dataType.simpleString()
    kinds = ", ".join(f"`{name}` array<array<{kind}>>" for name, kind in _TREE.items())
    return vectors.mapInArrow(arrange, f"vec_id array<bigint>, label array<{labels}>, {kinds}")


def _trees(batch: pa.RecordBatch, i: int, parts: int) -> Iterator[dict[str, np.ndarray]]:
    row = {name: batch.column(name)[i].values for name in _TREE}
    for part in range(parts):
        yield {name: values[part].values.to_numpy() for name, values in row.items()}


def _refined(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round. `books` is parts x entries x components."""
    parts, entries, size = books.shape

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros_like(books)
        for batch in batches:
            for i in range(len(batch)):
                for part, tree in enumerate(_trees(batch, i, parts)):
                    n, s = _Search(tree, books[part]).totals()
                    counts[part] += n
                    sums[part] += s
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used),
                pa.array(counts.ravel()[used]),
                *(pa.array(sums[..., c].ravel()[used]) for c in range(size)),
            ],
            names=["entry", "n", *(f"s{c}" for c in range(size))],
        )

    columns = ["n", *(f"s{c}" for c in range(size))]
    schema = ", ".join(["entry bigint", *(f"{c} bigint" for c in columns)])
    found = chunks.select(*_TREE).mapInArrow(gather, schema)
    refined = books.reshape(-1, size).copy()
    # As many rows as there are entries.
    for entry, n, *sums in found.groupBy("entry").agg(*(F.sum(c) for c in columns)).collect():
        refined[entry] = np.array(sums, np.int64) // n
    return refined.reshape(books.shape)


@dataclass
class Codes:
    """`coded` has `vec_id`, `label`, `code` and `error`; `books` is parts x entries x components."""

    coded: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def encode(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> Codes:
    """Codes of all vectors that take part. `code` has two hex digits for each part, `error` the
    square distances of the scaled parts to their entries. A component x counts as
    floor(256 * x)."""
    kept = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    ).where(is_finite(F.col("v")))
    size = dimensions(kept, "vec_id", "v")
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    scaled = F.transform("v", lambda x: F.floor(x * SCALE))
    kept = kept.where(F.size("v") == size)
    if kept.where(F.exists("v", lambda x: F.abs(x * SCALE) > MOST_COMPONENT)).limit(1).count():
        raise ValueError(f"components beyond {MOST_COMPONENT / SCALE:g} are not supported")
    points = kept.select("vec_id", "label", scaled.alias("v"))
    first = points.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    books = np.array([row.v for row in first], np.int64).reshape(len(first), parts, size // parts)
    books = np.ascontiguousarray(books.swapaxes(0, 1))
    labels = points.schema["label"].dataType.simpleString()
    schema = f"vec_id bigint, label {labels}, code string, error bigint"
    if not first:
        return Codes(points.sparkSession.createDataFrame([], schema), books)
    chunks = written(_chunks(points, size, parts), "vector-trees", LARGE_ROWS)
    for _ in range(rounds):
        books = _refined(chunks, books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                found = [
                    _Search(tree, books[part]).entries()
                    for part, tree in enumerate(_trees(batch, i, parts))
                ]
                codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id")[i].values,
                        batch.column("label")[i].values,
                        pa.array([row.tobytes().hex() for row in codes], pa.string()),
                        pa.array(sum(f[1] for f in found)),
                    ],
                    names=["vec_id", "label", "code", "error"],
                )

    return Codes(chunks.mapInArrow(assign, schema), books)


def with_label_errors(codes: Codes) -> DataFrame:
    """The coded rows with `label_error`, the error summed over all rows of the label; null is a
    label, too."""
    coded = written(codes.coded, "vector-codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return (
        coded.join(totals.withColumnRenamed("label", "_of"), F.col("label").eqNullSafe(F.col("_of")))
        .drop("_of")
        .withColumn("codebooks_sha256", F.lit(codes.digest()))
    )
