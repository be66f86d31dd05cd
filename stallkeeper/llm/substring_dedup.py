"""Passages that documents share, by content-defined chunking.

Chunks begin at word starts chosen by their content: of each `WINDOW_WORDS` word starts in a row, the
one with the smallest hash of the bytes that follow. A chunk ends after `CHUNK_WORDS` words or at the
first cut of a gear hash at least `LEAST_BYTES` on, whichever comes first. All of that depends on the
bytes nearby alone, so a passage of `WINDOW_WORDS + CHUNK_WORDS - 1` whole words holds a whole chunk
in every document it stands in, however short the words. Where there are no blanks, chunks begin at
the cuts. Chunks of equal digest in different documents are duplicates, and adjoining ones make up
a span. Spans of fewer than `LEAST_SPAN_WORDS` words are left alone.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stallkeeper.llm.runs import shared_rows
from stallkeeper.llm.scratch import document_key, given_id, partitions_for, written

# One place in so many is a cut; the hash of a place depends on the 16 bytes up to it.
CUT_EVERY = 20
WINDOW = 16
# A chunk goes to the first cut so many bytes on, or the end of its last word if that comes first.
# With 8 word starts to choose from, 49 words hold a chunk: 51 without the two at the borders, which
# may have other letters or marks around them.
LEAST_BYTES = 112
CHUNK_WORDS = 42
WINDOW_WORDS = 8
# Without a cut for so long, as in a word said again and again, there is one by count.
MOST_GAP = 128
MOST_BYTES = LEAST_BYTES + MOST_GAP
# What chunks within a passage of 51 words cover of it is 25 words or more, and at most the passage.
LEAST_SPAN_WORDS = 24
# Of a run without blanks, longer words than there are, so many bytes count as a word.
RUN_BYTES = 24
RUN_WORD_BYTES = 6
# A chunk's start, the number of words before it, and its words and length, in one number. Numbers
# of words are kept modulo 2^18: a span of more bytes is long enough anyway.
_LENGTH_BITS = 8
_WORDS_BITS = 6
_BEFORE_BITS = 18
_START_AT = _LENGTH_BITS + _WORDS_BITS + _BEFORE_BITS
# Bytes of text for each partition of chunks; of a byte of text, chunks make some three.
BYTES_PER_PARTITION = 1 << 28
_BLOCK = 1 << 20

# The numbers of the gear hash: any fixed ones will do that look random.
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 16, 256, dtype=np.uint16)
_BELOW = (1 << 16) // CUT_EVERY
_IS_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _gear(raw: np.ndarray) -> np.ndarray:
    """h(i) = 2 h(i - 1) + gear(byte i), modulo 2^16, for all places by doubling the window."""
    h = _GEAR[raw]
    width = 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint16(width)
        h, width = longer, 2 * width
    return h


def _hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash of each place: of the up to `WINDOW` bytes that end with it."""
    found = [np.empty(0, np.uint16)]
    for at in range(0, len(data), _BLOCK):
        before = min(at, WINDOW - 1)
        found.append(_gear(data[at - before : at + _BLOCK])[before:])
    return np.concatenate(found)


def _gear_cuts(h: np.ndarray) -> np.ndarray:
    places = np.flatnonzero(h < _BELOW) + 1
    return places[places > WINDOW]


def _spaced(places: np.ndarray, end: int, most: int) -> np.ndarray:
    """The places, with others by count where there is none for more than `most` bytes."""
    gaps = np.diff(np.append(places, end))
    extra = [
        np.arange(start + most, start + gap, most)
        for start, gap in zip(places[gaps > most], gaps[gaps > most], strict=True)
    ]
    return np.unique(np.concatenate([places, *extra]))


def cuts(raw: bytes) -> np.ndarray:
    """Places (byte offsets) where the gear hash cuts, and by count where it does not, without the
    end of the text."""
    found = _gear_cuts(_hashes(np.frombuffer(raw, np.uint8)))
    return _spaced(np.concatenate([[0], found]), len(raw), MOST_GAP)


def _chosen_words(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of each `WINDOW_WORDS` word starts in a row, the one with the smallest hash of the bytes from
    it on, the first of equal ones."""
    words = words[words + WINDOW <= len(h)]
    if len(words) < WINDOW_WORDS:
        return words
    windows = np.lib.stride_tricks.sliding_window_view(h[words + WINDOW - 1], WINDOW_WORDS)
    return words[np.unique(windows.argmin(axis=1) + np.arange(len(windows)))]


def words_before(raw: bytes) -> np.ndarray:
    """For each place, and the end, how many words begin before it. In a run without blanks, which
    may be a text of a language that has none, a word is counted every so many bytes."""
    blank = _IS_BLANK[np.frombuffer(raw, np.uint8)]
    at = np.arange(len(blank))
    after = np.concatenate([[True], blank[:-1]])
    run = at - np.maximum.accumulate(np.where(after, at, 0))
    begins = after | ((run >= RUN_BYTES) & (run % RUN_WORD_BYTES == 0))
    return np.concatenate([[0], np.cumsum(begins & ~blank)])


def chunks(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every chunk. The beginning of the text is a start, and its end a cut."""
    data = np.frombuffer(raw, np.uint8)
    h, blank = _hashes(data), _IS_BLANK[data]
    borders = np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))
    words, word_ends = np.flatnonzero(borders < 0), np.flatnonzero(borders > 0)
    found = _gear_cuts(h)
    blanks = np.concatenate([[0], np.cumsum(blank)])
    inside = found[blanks[found] == blanks[found - WINDOW]]  # of a word longer than the window
    starts = np.unique(np.concatenate([[0], _chosen_words(h, words), inside]))
    starts = _spaced(starts, len(raw), LEAST_BYTES)  # so that chunks adjoin
    none = len(raw) + 1
    places = np.concatenate([found[found < len(raw)], [len(raw), none]])
    by_bytes = places[np.minimum(np.searchsorted(places, starts + LEAST_BYTES), len(places) - 1)]
    by_count = np.where(starts + MOST_BYTES <= len(raw), starts + MOST_BYTES, none)
    last_word = np.searchsorted(word_ends, starts, "right") + CHUNK_WORDS - 1
    by_words = np.append(word_ends, none)[np.minimum(last_word, len(word_ends))]
    ends = np.minimum(np.minimum(by_bytes, by_count), by_words)
    return starts[ends < none], ends[ends < none]


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_k1", "_k2", "_doc", "_text", "_place"]
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        ids, hashes, texts = (batch.column(n) for n in ("_id", "_text", "text"))
        owner, places, digests = [], [], []
        for row, text in enumerate(texts):
            raw = (text.as_py() or "").encode()
            if len(raw) < 2 * CHUNK_WORDS - 1:  # so many words have
                continue
            a, b = chunks(raw)
            before = words_before(raw)
            within = np.minimum(before[b] - before[a], (1 << _WORDS_BITS) - 1)
            place = (a << _BEFORE_BITS) + (before[a] & ((1 << _BEFORE_BITS) - 1))
            owner.append(np.full(len(a), row, np.int64))
            places.append((((place << _WORDS_BITS) + within) << _LENGTH_BITS) + b - a)
            digests += [digest(raw[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        whole = [np.concatenate([np.empty(0, np.int64), *x]) for x in (owner, places)]
        take = pa.array(whole[0])
        columns = [halves[:, 0], halves[:, 1], ids.take(take), hashes.take(take), whole[1]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _bits(value: Column, at: int, count: int) -> Column:
    return F.shiftright(value, at).bitwiseAND((1 << count) - 1)


def _spans(chunked: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`chunked` with the number of the span that each chunk is in: chunks overlap or adjoin, and a
    span goes on while the next one begins before it ends."""
    of_text = Window.partitionBy(*keys).orderBy("_start", "_end")
    reach = F.max("_end").over(of_text.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("_start") > reach, F.lit(True))
    return chunked.withColumn("_begins", begins.cast("int")).withColumn(
        name, F.sum("_begins").over(of_text)
    )


def _is_long(of_span: WindowSpec) -> Column:
    """Whether a span has words enough, from the words before its first and last chunk and those in
    the last."""
    first, last = F.min("_start").over(of_span), F.max("_end").over(of_span)
    ends = F.max(F.struct("_end", "_start", "_before", "_words")).over(of_span)
    begins = F.min(F.struct("_start", "_end", "_before")).over(of_span)
    rounds = 1 << _BEFORE_BITS
    words = F.pmod(ends["_before"] - begins["_before"], F.lit(rounds)) + ends["_words"]
    return (words >= LEAST_SPAN_WORDS) | (last - first >= rounds)


def shared_passages(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row for each span of a document that other documents have, too: `doc_id`, `start` and
    `end` (byte offsets in UTF-8), and `removed`: whether all of the span's chunks occur in
    documents of smaller ids, so that the span can go while one copy stays.

    A span in which both kinds of chunks adjoin is given in parts, and is left alone if it has
    fewer than `LEAST_SPAN_WORDS` words as a whole. Documents without such a span have no row; nor
    have null, empty and short texts. Null ids are together one document that ranks below all
    others; rows with the same id and text have the same spans, given once. `partitions` follow
    from the bytes of the texts.
    """
    rows = docs.select(*document_key(), "text").mapInArrow(
        _chunk_rows, "_k1 bigint, _k2 bigint, _doc bigint, _text bigint, _place bigint"
    )
    shared = shared_rows(
        rows,
        ["_text", "_place"],
        2,
        descending=False,
        partitions=partitions or partitions_for(docs, BYTES_PER_PARTITION),
        write=lambda df: written(df, "chunks"),
    )
    start = F.shiftright("_place", _START_AT)
    placed = shared.select(
        "_doc",
        "_text",
        "_later",
        start.alias("_start"),
        (start + _bits(F.col("_place"), 0, _LENGTH_BITS)).alias("_end"),
        _bits(F.col("_place"), _LENGTH_BITS, _WORDS_BITS).alias("_words"),
        _bits(F.col("_place"), _LENGTH_BITS + _WORDS_BITS, _BEFORE_BITS).alias("_before"),
    ).distinct()
    whole = _spans(placed, ["_doc", "_text"], "_whole")
    of_span = Window.partitionBy("_doc", "_text", "_whole")
    long = whole.withColumn("_long", _is_long(of_span)).where("_long")
    spans = (
        _spans(long, ["_doc", "_text", "_later"], "_span")
        .groupBy("_doc", "_text", "_later", "_span")
        .agg(F.min("_start").alias("start"), F.max("_end").alias("end"))
    )
    return spans.select(
        given_id("_doc").alias("doc_id"), "start", "end", F.col("_later").alias("removed")
    )
