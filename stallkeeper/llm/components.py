"""Connected components of links between numbers, by alternating large and small stars."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lowest(edges: DataFrame) -> DataFrame:
    """Each edge `a`, `b` with `m`, the lowest of `a` and its neighbours. The minimum is combined
    before the shuffle; the join may split the edges of a node with many."""
    lowest = edges.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return edges.join(lowest, "a")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`node` and `root`, the lowest node of its component, for all nodes but the roots.

    `edges` has bigint columns `a` and `b`; repeated edges and loops do no harm. Each round is
    written, so that its lineage stays short and a lost executor costs no earlier round.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = write(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _lowest(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        stars = _lowest(large)
        small = stars.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = write(small.where("a <> b").distinct())
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
