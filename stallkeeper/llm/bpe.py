"""Byte-level BPE: texts to token ids and back.

A token sequence is what the merges would give exactly if each two neighbours in it are: if
merging the bytes of both, by rank, ends with just these two tokens. So a text is encoded by
taking the longest token at each place, going back to shorter ones where neighbours do not fit,
and never trying a place again from which there was no way on. Which tokens begin where is found
by one Aho-Corasick pass over the bytes, each written as the character of the same number; often
no going back is needed, and the longest tokens alone are looked at first.
"""

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm.scratch import bound_batches

# Fixed value: how this family of vocabularies cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Bounds for each Python worker; what does not fit is worked out again.
MAX_PAIRS = 150_000
MAX_CACHED = 200_000
BATCH_BYTES = 1 << 20  # of ids, beyond which a worker hands on what it has
LONGEST_CACHED = 64  # characters; text without spaces would fill the caches with whole lines
NONE = -1


class Vocabulary:
    """Tokens by rank; every byte must be one, and every other must arise by merging."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._never = max(ranks.values()) + 1
        self.tokens = [b""] * self._never
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = [len(token) for token in self.tokens]
        self._left_edges: dict[int, tuple[int, ...]] = {}
        self._right_edges: dict[int, tuple[int, ...]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        for rank in sorted(ranks.values()):
            self._add_edges(rank)
        self.shorter = [self._longest_prefix(token) for token in self.tokens]
        self._places = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._places.add_word(token.decode("latin-1"), rank)
        self._places.make_automaton()

    def _longest_prefix(self, token: bytes) -> int:
        prefixes = (self.ranks.get(token[:n]) for n in range(len(token) - 1, 0, -1))
        return next((rank for rank in prefixes if rank is not None), NONE)

    def _add_edges(self, rank: int) -> None:
        """The tokens that stood at either end of a token while it was merged, in that order."""
        token = self.tokens[rank]
        if len(token) == 1:
            self._left_edges[rank] = self._right_edges[rank] = (rank,)
            return
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            known = [self.ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
            first = min(range(len(known)), key=known.__getitem__)
            if known[first] >= rank:
                raise ValueError(f"token {rank} does not arise by merging")
            parts[first : first + 2] = [parts[first] + parts[first + 1]]
        left, right = (self.ranks[part] for part in parts)
        if max(left, right) > rank:
            raise ValueError(f"token {rank} has a lower rank than its parts")
        self._left_edges[rank] = (*self._left_edges[left], rank)
        self._right_edges[rank] = (*self._right_edges[right], rank)

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both ends with `a`, `b`."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) >= MAX_PAIRS:
                self._fits.clear()
            known = self._fits[a, b] = self._stays_apart(a, b)
        return known

    def _stays_apart(self, a: int, b: int) -> bool:
        ends, starts = self._right_edges[a], self._left_edges[b]
        i = j = 0
        while True:
            joined = self.ranks.get(self.tokens[ends[i]] + self.tokens[starts[j]], self._never)
            next_end = ends[i + 1] if i + 1 < len(ends) else self._never
            next_start = starts[j + 1] if j + 1 < len(starts) else self._never
            # Lower ranks merge first, equal ones from left to right.
            if joined < next_end and joined <= next_start and joined != self._never:
                return False
            if next_end == next_start == self._never:
                return True
            if next_end <= next_start:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        lengths, known, fits = self.lengths, self._fits, self.fits
        ids: list[int] = []
        at, last, text = 0, NONE, piece.decode("latin-1")
        for end, token in self._places.iter_long(text):
            if last >= 0:
                fit = known.get((last, token))
                if not (fit or fit is None and fits(last, token)):
                    break
            ids.append(token)
            at, last = at + lengths[token], token
        if at == len(piece):
            return ids
        return self._go_back(piece, text)

    def _go_back(self, piece: bytes, text: str) -> list[int]:
        lengths, shorter, known, fits = self.lengths, self.shorter, self._fits, self.fits
        longest = [NONE] * (len(piece) + 1)
        for end, token in self._places.iter(text):
            longest[end + 1 - lengths[token]] = token  # ends ascend, so the longest stays
        dead = bytearray(len(piece) + 1)
        ids: list[int] = []
        at, token, size, last = 0, longest[0], len(piece), NONE
        while at < size:
            while token >= 0:
                end = at + lengths[token]
                if not dead[end]:
                    if last < 0:
                        break
                    fit = known.get((last, token))
                    if fit or fit is None and fits(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at, last, token = end, token, longest[end]
            else:
                dead[at] = 1
                token = ids.pop()
                at -= lengths[token]
                token, last = shorter[token], ids[-1] if ids else NONE
        return ids


class _Recent(dict):
    """What `make` gives, kept for at least the last `MAX_CACHED` different keys but long ones."""

    def __init__(self, make):
        super().__init__()
        self._make = make
        self._before: dict = {}

    def __missing__(self, key):
        found = self._before.get(key)
        if found is None:
            found = self._make(key)
            if len(key) > LONGEST_CACHED:
                return found
        if len(self) >= MAX_CACHED:
            self._before = dict(self)
            self.clear()
        self[key] = found
        return found

    def forget(self) -> None:
        self._before = {}
        self.clear()


class Encoder:
    """Whole texts to ids, each as four bytes, the lowest first."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self._vocabulary = vocabulary
        self._pieces = regex.compile(pattern).findall
        # Under this pattern a space after any other character than white space begins a piece.
        self._cut_at_spaces = pattern == PATTERN
        self._other_space = regex.compile(r"\s ").search
        self._recent = _Recent(self._encode_piece), _Recent(self._encode_word)
        self._of_piece, self._of_word = (recent.__getitem__ for recent in self._recent)

    def __call__(self, text: str) -> bytes:
        if not self._cut_at_spaces or self._other_space(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        return self._encode(first) + b"".join(map(self._of_word, rest))

    def forget(self) -> None:
        """Lets the memory go that earlier texts took."""
        for recent in self._recent:
            recent.forget()

    def _encode(self, text: str) -> bytes:
        return b"".join(map(self._of_piece, self._pieces(text)))

    def _encode_word(self, word: str) -> bytes:
        """What a space and `word` give. The first piece begins with that space and is a piece by
        itself, too, so a word is kept once, whatever marks follow it."""
        text = f" {word}"
        if word.isascii() and word.isalpha():
            return self._encode_piece(text)
        first, *others = self._pieces(text)
        if not others:
            return self._encode_piece(text)
        return self._of_word(first[1:]) + b"".join(map(self._of_piece, others))

    def _encode_piece(self, piece: str) -> bytes:
        ids = self._vocabulary.encode_piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)


class Decoder:
    """Ids, as the encoder gives them, to the bytes of their tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self._tokens = np.full(max(ranks.values()) + 1, None, object)
        for token, rank in ranks.items():
            self._tokens[rank] = token

    def __call__(self, ids: bytes) -> bytes:
        return b"".join(self._tokens[np.frombuffer(ids, "<u4")].tolist())


def read_ranks(content: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


@lru_cache(maxsize=1)
def _encoder(content: bytes, pattern: str) -> Encoder:
    return Encoder(Vocabulary(read_ranks(content)), pattern)


@lru_cache(maxsize=1)
def _decoder(content: bytes) -> Decoder:
    return Decoder(read_ranks(content))


def _encoded(texts: Iterator[pd.Series], content: bytes, pattern: str) -> Iterator[list[bytes]]:
    """The ids of all texts, a few texts at a time, as a batch may hold thousands; what the worker
    keeps for its next task is the vocabulary alone."""
    encoder = _encoder(content, pattern)
    try:
        for batch in texts:
            found, size = [], 0
            for text in batch:
                found.append(encoder(text or ""))
                size += len(found[-1])
                if size >= BATCH_BYTES:
                    yield found
                    found, size = [], 0
            if found:
                yield found
    finally:
        encoder.forget()


class ByteBpe:
    """Column functions for the vocabulary in a file of lines `base64(token) rank`.

    The file is read on the driver; its content (under a megabyte) goes to the executors.
    """

    def __init__(self, spark, path: str, pattern: str = PATTERN):
        bound_batches(spark)
        with open(path, "rb") as file:
            content = spark.sparkContext.broadcast(file.read())

        @F.pandas_udf("binary")
        def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for ids in _encoded(texts, content.value, pattern):
                yield pd.Series(ids, dtype=object)

        @F.pandas_udf("binary")
        def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
            decoder = _decoder(content.value)
            for batch in ids:
                yield pd.Series([decoder(x or b"") for x in batch], dtype=object)

        @F.pandas_udf("ids binary, decoded binary")
        def round_trip(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            decoder = _decoder(content.value)
            for ids in _encoded(texts, content.value, pattern):
                yield pd.DataFrame({"ids": ids, "decoded": list(map(decoder, ids))}, dtype=object)

        self._encode, self._decode, self._round_trip = encode, decode, round_trip

    def encode(self, text: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers; none for a null or empty text."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """The bytes of the tokens; none for null."""
        return self._decode(ids)


    def round_trip(self, text: Column) -> Column:
        """Both at once: a struct of `ids` and of the bytes they are `decoded` to."""
        return self._round_trip(text)


def encode_documents(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded bytes of every document, a row for each row.

    Null and empty texts have no tokens. Repeated rows and null ids stay as they are; other
    columns are not read. There is no shuffle, and nothing is kept beyond one batch of texts,
    the ids of a few of them and bounded caches.
    """
    bpe = ByteBpe(docs.sparkSession, path, pattern)
    found = docs.select("doc_id", bpe.round_trip(F.col("text")).alias("_found"))
    return found.select(
        "doc_id",
        (F.octet_length("_found.ids") / 4).cast("bigint").alias("n_tokens"),
        "_found.ids",
        "_found.decoded",
    )
