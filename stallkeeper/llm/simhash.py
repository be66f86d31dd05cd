"""Near-duplicates by SimHash fingerprints that differ in a few bits.

A fingerprint is cut into so few segments that of two linked ones some segment differs in one bit
at most. Each segment is indexed once for each of its bits, without that bit, so that the two meet
under an equal variant; pairs that meet are verified. Exact copies are one fingerprint throughout.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm.components import components
from stallkeeper.llm.scratch import bound_batches, document_key, written

BITS = 64
# Fixed value: the seed of the shingle hashes.
SEED = 42
# Variants that more fingerprints share are linked by common neighbours instead of pair by pair.
MOST_PAIRED = 64
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle_words: int) -> int:
    """As a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words])
    width = min(shingle_words, len(words))
    starts = [0, *ends[: len(words) - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], ">u8"
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int) -> DataFrame:
    """`_id`, `_text` (see `document_key`), `doc_id` and `_fp` of every row."""

    bound_batches(docs.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle_words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_id", "_text", "doc_id")), pa.array(found, pa.int64())],
                ["_id", "_text", "doc_id", "_fp"],
            )

    wanted = docs.select(*document_key(), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return wanted.mapInArrow(prints, "_id bigint, _text bigint, doc_id bigint, _fp bigint")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """Shift and width of each segment."""
    count = max(2, max_bits // 2 + 1)
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _variants(fp: Column, max_bits: int) -> Column:
    return F.array(
        *[
            _segment(fp, shift, width).bitwiseAND(F.lit(~(1 << bit)))
            for shift, width in _segments(max_bits)
            for bit in range(width)
        ]
    )


def _first_shared(difference: Column, max_bits: int) -> Column:
    """Number of the first variant that two fingerprints with these differing bits share."""
    first, before = None, 0
    for shift, width in _segments(max_bits):
        bits = _segment(difference, shift, width)
        same = F.when(bits == 0, F.lit(before)).when(
            F.bit_count(bits) == 1, F.lit(before) + F.bit_count(bits - 1)
        )
        first = same if first is None else F.coalesce(first, same)
        before += width
    return first


def _near(fps: DataFrame, max_bits: int) -> DataFrame:
    """Fingerprint and each that differs from it in `max_bits` // 2 bits or fewer (0 or 1)."""
    changed = [F.col("_fp")]
    if max_bits == 2:
        changed += [
            F.col("_fp").bitwiseXOR(F.lit((1 << b) - (1 << BITS) * (b == BITS - 1)))
            for b in range(BITS)
        ]
    return fps.select("_fp", F.explode(F.array(*changed)).alias("_near"))


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links `a`, `b` between different fingerprints (`_fp`, distinct) whose components are those
    of all links of at most `max_bits` differing bits; every row links two such fingerprints, or
    two of a chain of them.

    Beyond `MOST_PAIRED` fingerprints under one variant, and for two bits, those are linked
    through what they have in common instead: two fingerprints differ in two bits or fewer exactly
    if some number differs from each in one or none, and at most 65 meet there.
    """
    keyed = fps.select(F.col("_fp"), F.posexplode(_variants(F.col("_fp"), max_bits)))
    bucket = ["pos", "col"]
    met = keyed.withColumn("_n", F.count("*").over(Window.partitionBy(*bucket)))
    met = written(met.where("_n > 1"), "variants")
    crowded = F.col("_n") > MOST_PAIRED if max_bits == 2 else F.lit(False)
    left = met.where(~crowded).select(*bucket, F.col("_fp").alias("a"))
    right = met.where(~crowded).select(*bucket, F.col("_fp").alias("b"))
    difference = F.col("a").bitwiseXOR(F.col("b"))
    verified = (
        (F.col("a") < F.col("b"))
        & (F.bit_count(difference) <= max_bits)
        & (F.col("pos") == _first_shared(difference, max_bits))
    )
    paired = left.join(right, bucket).where(verified).select("a", "b")
    if max_bits != 2:
        return paired
    near = _near(met.where(crowded).select("_fp").distinct(), max_bits)
    meeting = near.groupBy("_near").agg(F.collect_list("_fp").alias("_fps"))
    chained = meeting.where(F.size("_fps") > 1).select(
        F.array_min("_fps").alias("a"), F.explode("_fps").alias("b")
    )
    return paired.unionByName(chained.where("a <> b"))


def _roots(prints: DataFrame, max_bits: int) -> DataFrame:
    """`_fp` and `_root`, the fingerprint that stands for its component."""
    fps = prints.select("_fp").distinct()
    found = components(links(fps, max_bits), lambda df: written(df, "stars"))
    found = found.withColumnRenamed("node", "_fp")
    return fps.join(found, "_fp", "left").select("_fp", F.coalesce("root", "_fp").alias("_root"))


def near_duplicates(docs: DataFrame, shingle_words: int, max_bits: int) -> DataFrame:
    """`doc_id`, `fingerprint` (16 hexadecimal digits) and `component_id`, the smallest doc_id that
    is reachable over links, for every row.

    Null and empty texts have the fingerprint zero and are linked like any other. Null ids are
    not among the smallest: a component of null ids alone has a null one. Repeated rows are kept.
    Other columns are not read.
    """
    prints = written(fingerprints(docs, shingle_words).drop("_id", "_text"), "fingerprints")
    firsts = prints.groupBy("_fp").agg(F.min("doc_id").alias("_first"))
    roots = written(_roots(prints, max_bits).join(firsts, "_fp"), "roots")
    ids = roots.groupBy("_root").agg(F.min("_first").alias("component_id"))
    of_print = roots.join(ids, "_root").select("_fp", "component_id")
    return prints.join(of_print, "_fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, shingle_words: int, max_bits: int) -> DataFrame:
    """The rows of `docs` without all but one of each component: the one with the smallest id
    (null below all others, then the smallest hash of the text); of repeated rows, one stays.
    """
    prints = written(fingerprints(docs, shingle_words).drop("doc_id"), "fingerprints")
    firsts = prints.groupBy("_fp").agg(F.min(F.struct("_id", "_text")).alias("_first"))
    kept = firsts.join(_roots(prints, max_bits), "_fp").groupBy("_root")
    kept = kept.agg(F.min("_first").alias("_first")).select("_first.*")
    keyed = docs.select(F.struct("*").alias("_row"), *document_key())
    once = Window.partitionBy("_id", "_text").orderBy("_id")
    return (
        keyed.join(kept, ["_id", "_text"], "left_semi")
        .withColumn("_nth", F.row_number().over(once))
        .where("_nth = 1")
        .select("_row.*")
    )
