"""Byte-level BPE against the public library, and exact round trips."""

import hashlib
import random
import struct

import pandas as pd
import pytest
import tiktoken
from samples import documents, odd_rows, same, with_clashes

from stallkeeper.llm import bpe
from stallkeeper.llm.queries import op1_byte_bpe, vocabulary_path


@pytest.fixture(scope="module")
def ranks():
    with open(vocabulary_path(), "rb") as file:
        return bpe.read_ranks(file.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding(
        "own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


@pytest.fixture(scope="module")
def both(ranks):
    return bpe.Encoder(bpe.Vocabulary(ranks)), bpe.Decoder(ranks)


def ids_of(encoded: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(encoded) // 4}I", encoded))


ALPHABETS = ["a", "ab", "aA b", "thein ", "0123 ", "\n ab", "é ça", "☃😀a ", " \t\n.,'s", "\x1c\x85\xa0 a"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_same_as_the_library(both, library, alphabet):
    encode, decode = both
    r = random.Random(alphabet)
    for _ in range(300):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
        encoded = encode(text)
        assert ids_of(encoded) == library(text)
        assert decode(encoded) == text.encode()


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 5_000, "ab" * 20_000, "'s" * 999, "é" * 9_999])
def test_long_pieces(both, library, text):
    assert ids_of(both[0](text)) == library(text)


def test_any_characters(both, library):
    r = random.Random(3)
    for _ in range(300):
        codes = [r.choice([r.randrange(0xD800), r.randrange(0xE000, 0x110000)]) for _ in range(20)]
        text = "".join(map(chr, codes))
        assert ids_of(both[0](text)) == library(text)


def test_other_pattern(ranks):
    pattern = r"[a-z]+|[^a-z]"
    encode = bpe.Encoder(bpe.Vocabulary(ranks), pattern)
    library = tiktoken.Encoding("o", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    text = "some words, and  spaces"
    assert ids_of(encode(text)) == library.encode_ordinary(text)


def test_unfit_vocabularies_are_refused(ranks):
    with pytest.raises(ValueError, match="every byte"):
        bpe.Vocabulary({b"a": 0})
    letters = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError, match="does not arise"):
        bpe.Vocabulary(letters | {b"abc": 256})


def test_caches_forget_but_stay_right(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CACHED", 3)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 5)
    encode = bpe.Encoder(bpe.Vocabulary(ranks))
    text = "athe bthend cthion dering there athe " * 5
    assert ids_of(encode(text)) == library(text)


def test_words_are_kept_once_whatever_follows(ranks, library):
    encode = bpe.Encoder(bpe.Vocabulary(ranks))
    words = [f"{a}{b}thri" for a in "abcdé" for b in "xyzßñ"]
    text = "start " + " ".join(f"{word} {word}" for word in words)
    assert ids_of(encode(text)) == library(text)
    assert sum(map(len, encode._recent)) == 1 + len(words)
    marked = "start " + " ".join(f"{word}, {word}.\n'{word}'s " for word in words)
    assert ids_of(encode(marked)) == library(marked)


def test_lines_without_spaces_are_not_kept(ranks, library):
    encode = bpe.Encoder(bpe.Vocabulary(ranks))
    text = " ".join("漢字" * n for n in range(40, 60)) + " " + "x" * 5000
    for _ in range(2):
        assert ids_of(encode(text)) == library(text)
    assert sum(map(len, encode._recent)) == 0


def test_nothing_goes_back_where_the_longest_tokens_fit(ranks, library, monkeypatch):
    vocabulary, gone = bpe.Vocabulary(ranks), []
    back = vocabulary._go_back
    monkeypatch.setattr(vocabulary, "_go_back", lambda *a: gone.append(a[0]) or back(*a))
    r = random.Random(8)
    words = {"".join(r.choice(["an", "ed", "ing", "re", "th"]) for _ in range(5)) for _ in range(500)}
    for word in words:
        assert vocabulary.encode_piece(f" {word}".encode()) == library(f" {word}")
    assert 0 < len(gone) < 0.8 * len(words)


def test_ids_leave_the_worker_in_bounded_batches(library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_BYTES", 400)
    with open(vocabulary_path(), "rb") as file:
        content = file.read()
    r = random.Random(4)
    texts = [" ".join(["word"] * r.randrange(30)) for _ in range(300)] + [None, "", "x y " * 900]
    batches = list(bpe._encoded(iter([pd.Series(texts), pd.Series([], dtype=object)]), content, bpe.PATTERN))
    assert all(sum(map(len, found[:-1])) < 400 for found in batches)
    assert [ids_of(x) for found in batches for x in found] == [library(t or "") for t in texts]


def test_more_text_than_a_batch(spark, library):
    """Several batches of ids for one of texts: every row keeps its own."""
    rows = [(i, f"row {i} has its own words " * (i % 90), "en", "s", 0) for i in range(9000)]
    docs = documents(spark, rows).coalesce(1)
    found = bpe.encode_documents(docs, vocabulary_path())
    assert sum(len(x.ids) for x in found.collect()) > 3 * bpe.BATCH_BYTES
    for row in found.where("doc_id % 500 < 3").collect():
        assert ids_of(row.ids) == library(rows[row.doc_id][1])
        assert bytes(row.decoded) == rows[row.doc_id][1].encode()


def expected(rows, library):
    for doc_id, text, *_ in rows:
        ids = library(text or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        plain = (text or "").encode()
        yield doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(plain).hexdigest()


def test_documents(spark, library, tmp_path):
    docs = with_clashes(documents(spark))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert same(op1_byte_bpe(spark, str(tmp_path)).collect()) == same(
        expected(odd_rows(), library)
    )


def test_empty_table(spark):
    encoded = bpe.encode_documents(documents(spark, []), vocabulary_path())
    assert encoded.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert encoded.collect() == []
