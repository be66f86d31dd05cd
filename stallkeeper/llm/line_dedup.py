"""Line de-duplication across documents.

Keys of lines are range-partitioned and sorted by document and position, and streamed: all lines
of a shared key go but those of its first document in that order, the one with the largest id.
What comes out is a compressed bitmap of kept lines for each document that loses any, not text;
applying it to the texts is a step of its own.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallkeeper.llm.runs import shared_rows
from stallkeeper.llm.scratch import (
    NO_ID,
    bound_batches,
    document_key,
    given_id,
    partitions_for,
    written,
)

LEAST_CODE_POINTS = 20
LEAST_DOCUMENTS = 3
# Bytes of text for each partition of lines.
BYTES_PER_PARTITION = 1 << 28
# Fixed value: white space that does not count at either end of a line.
BLANKS = b" \t\n\x0b\x0c\r"


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def line_key(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z in lower case."""
    return line.strip(BLANKS).lower()


def _keyed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_k1", "_k2", "_doc", "_text", "_pos"]
    for batch in batches:
        ids, hashes, texts = (batch.column(n) for n in ("_id", "_text", "text"))
        owner, pos, digests = [], [], []
        for row, text in enumerate(texts):
            for at, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                if len(line) < LEAST_CODE_POINTS:
                    continue
                key = line_key(line)
                if len(key) >= LEAST_CODE_POINTS and _code_points(key) >= LEAST_CODE_POINTS:
                    owner.append(row)
                    pos.append(at)
                    digests.append(xxhash.xxh3_128_digest(key))
        halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        take = pa.array(owner, pa.int64())
        columns = [
            pa.array(halves[:, 0]),
            pa.array(halves[:, 1]),
            ids.take(take),
            hashes.take(take),
            pa.array(pos, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)


@F.pandas_udf(T.BinaryType())
def _bitmap(dropped: pd.Series) -> pd.Series:
    def packed(positions) -> bytes:
        kept = np.ones(max(positions) // 8 * 8 + 8, np.uint8)
        kept[positions] = 0
        return zlib.compress(np.packbits(kept).tobytes())

    return dropped.map(packed)


def keep_bitmaps(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """For every document that loses lines: `doc_id`, the hash of its text, `n_dropped`, and
    `kept`, a zlib-compressed bitmap with a bit for each line, the first in the highest bit, 1 for
    kept. Lines beyond its end are kept.

    Documents are told apart by id in counting, null ids together being one that ranks below all
    others. Rows with the same id and text share a bitmap. Null and empty texts have no key that
    counts. Keys are compared by 128-bit hashes.
    """
    bound_batches(docs.sparkSession)
    lines = docs.select(*document_key(), "text").mapInArrow(
        _keyed_lines, "_k1 bigint, _k2 bigint, _doc bigint, _text bigint, _pos bigint"
    )
    partitions = partitions or partitions_for(docs, BYTES_PER_PARTITION)
    shared = shared_rows(
        lines,
        ["_text", "_pos"],
        LEAST_DOCUMENTS,
        descending=True,
        partitions=partitions,
        write=lambda df: written(df, "lines"),
    )
    dropped = shared.where("_later").groupBy(F.col("_doc").alias("_id"), "_text")
    return dropped.agg(F.collect_set("_pos").alias("_gone")).select(
        given_id().alias("doc_id"),
        F.col("_text").alias("text_hash"),
        F.size("_gone").cast("bigint").alias("n_dropped"),
        _bitmap(F.sort_array("_gone")).alias("kept"),
    )


def _kept_text(text: str | None, bitmap: bytes | None) -> str | None:
    if bitmap is None or text is None:
        return text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    lines = text.split("\n")
    kept = [line for at, line in enumerate(lines) if at >= len(bits) or bits[at]]
    return "\n".join(kept)


@F.pandas_udf(T.StringType())
def _apply(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
    return pd.Series(
        [_kept_text(t, b) for t, b in zip(texts, bitmaps, strict=True)], dtype=object
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`docs`, row for row, with `text` as it is kept, and `n_lines` (before, 1 for a null text)
    and `n_dropped`. Columns of these two names are replaced, all others stay. A document whose
    lines all go has an empty text, a null text stays null.
    """
    bound_batches(docs.sparkSession)
    added = ("n_lines", "n_dropped")
    columns = [c for c in docs.columns if c not in added]
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    theirs = bitmaps.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"),
        F.col("text_hash").alias("_text"),
        "n_dropped",
        "kept",
    )
    joined = docs.select(row, *document_key()).join(theirs, ["_id", "_text"], "left")
    text = F.col("_row.text")
    return joined.select(
        *[
            _apply(text, "kept").alias("text") if c == "text" else F.col(f"_row.`{c}`")
            for c in columns
        ],
        F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
    )
