"""Line de-duplication and shared passages against brute force, over cut and hot keys."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from samples import documents, lowered, odd_rows, same, sentence, with_clashes

from stallkeeper.llm import line_dedup, runs, substring_dedup
from stallkeeper.llm.queries import op9_line_dedup
from stallkeeper.llm.scratch import partitions_for, written

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return lowered(line.strip(BLANKS))


def brute(rows):
    rank = {None: -(1 << 63)}
    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(rank.get(doc_id, doc_id))
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [
            line
            for line in lines
            if len(holders[key(line)]) < 3 or max(holders[key(line)]) == rank.get(doc_id, doc_id)
        ]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        yield doc_id, len(lines), len(lines) - len(kept), digest


def shared_lines(count):
    r = random.Random(4)
    lines = [f"{sentence(r, 4)} Ünïcode line number {i}" for i in range(12)]
    for i in range(count):
        chosen = [lines[0], *r.choices(lines, k=r.randrange(4)), sentence(r, 5)]
        yield (1000 + i, "\n".join(chosen * r.randrange(1, 3)), "en", "s", 0)


def test_lines_of_documents(spark, tmp_path):
    rows = odd_rows() + list(shared_lines(300))
    with_clashes(documents(spark, rows)).write.parquet(f"{tmp_path}/documents.parquet")
    assert same(op9_line_dedup(spark, str(tmp_path)).collect()) == same(brute(rows))


@pytest.mark.parametrize("partitions", [1, 2, 31])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_hot_keys_over_borders_and_batches(spark, partitions, batch):
    """A line in every document: its rows fill several partitions."""
    rows = list(shared_lines(200))
    docs = documents(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        maps = line_dedup.keep_bitmaps(docs, partitions)
        got = line_dedup.apply_bitmaps(docs, maps).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    digests = [
        (r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got
    ]
    assert same(digests) == same(brute(rows))


def test_bitmaps_are_compressed_and_small(spark):
    rows = [(i, "\n".join(["a line of twenty letters"] * 8000), "en", "s", 0) for i in range(3)]
    maps = {r.doc_id: r for r in line_dedup.keep_bitmaps(documents(spark, rows)).collect()}
    assert set(maps) == {0, 1}
    assert maps[0].n_dropped == 8000
    assert len(maps[0].kept) < 100
    assert set(zlib.decompress(maps[0].kept)) == {0}


def test_columns_stay(spark):
    docs = with_clashes(documents(spark))
    after = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert after.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert after.count() == len(odd_rows())


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect() == []
    assert substring_dedup.shared_passages(docs).collect() == []


def planted(seed=5):
    r = random.Random(seed)
    passages = [sentence(r, 60) for _ in range(20)]
    rows, having = [], defaultdict(list)
    for i in range(300):
        parts = [sentence(r, r.randrange(10, 80))]
        if i % 3 == 0:
            chosen = r.randrange(20)
            parts += [passages[chosen], sentence(r, r.randrange(40))]
            having[chosen].append(i)
        rows.append((i, "x" * r.randrange(9) + " ".join(parts), "en", "s", 0))
    return rows, {k: v for k, v in having.items() if len(v) > 1}


@pytest.mark.parametrize("partitions", [1, 13])
def test_finds_planted_passages_and_nothing_else(spark, partitions):
    rows, having = planted()
    docs = with_clashes(documents(spark, rows))
    spans = substring_dedup.shared_passages(docs, partitions).collect()
    wanted = {i for ids in having.values() for i in ids}
    assert {row.doc_id for row in spans} == wanted
    text = {i: t.encode() for i, t, *_ in rows}
    for row in spans:
        passage = text[row.doc_id][row.start : row.end]
        holders = [i for i, t in text.items() if passage in t]
        assert len(holders) > 1
        assert not row.removed or row.doc_id > min(holders)


@pytest.mark.parametrize("letters", [1, 2, 3, 4, 5, 9])
def test_every_passage_of_51_words_holds_a_chunk(letters):
    """Between other words, quotes, line ends, and the ends of the text."""
    r = random.Random(letters)

    def words(count, length):
        return " ".join("".join(r.choices("abcdefghij", k=length)) for _ in range(count))

    def digests(text):
        raw = text.encode()
        starts, ends = substring_dedup.chunks(raw)
        return {raw[a:b] for a, b in zip(starts, ends, strict=True)}

    for _ in range(300):
        passage = words(51, letters)
        before, after = words(r.randrange(1, 60), 5), words(r.randrange(1, 60), 5)
        whole = digests(f'{before} "{passage}" {after}')
        for other in (passage, f"{after}\n{passage}", f"({passage}), {before}"):
            assert whole & digests(other)


def test_finds_passages_of_51_short_words(spark):
    r = random.Random(12)
    rows, wanted = [], set()
    for i in range(0, 120, 2):
        passage = " ".join("".join(r.choices("abcdefghij", k=2 + i % 3)) for _ in range(51))
        rows += [(i + j, f"{sentence(r, 30)} {passage} {sentence(r, 9)}", "en", "s", 0) for j in (0, 1)]
        wanted |= {i, i + 1}
    rows.append((999, sentence(r, 200), "en", "s", 0))
    spans = substring_dedup.shared_passages(documents(spark, rows)).collect()
    assert {row.doc_id for row in spans} == wanted


def test_leaves_short_passages_alone(spark):
    """Passages of 12 to 20 words, of any letters, are no duplicates; those of 51 words are."""
    r = random.Random(31)
    rows, wanted = [], set()
    for i in range(0, 240, 2):
        long = i % 4 == 0
        words = ["".join(r.choices("abcdefghij", k=1 + i % 13)) for _ in range(51 if long else 12 + i % 9)]
        rows += [
            (i + j, f"{sentence(r, 30)} ({' '.join(words)}), {sentence(r, 9)}", "en", "s", 0)
            for j in (0, 1)
        ]
        wanted |= {i, i + 1} if long else set()
    spans = substring_dedup.shared_passages(documents(spark, rows)).collect()
    assert {row.doc_id for row in spans} == wanted


def test_passages_without_blanks(spark):
    r = random.Random(32)
    rows = []
    for i in range(0, 40, 2):
        passage = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(200))
        rows += [(i + j, sentence(r, 30) + passage + sentence(r, 9), "zh", "s", 0) for j in (0, 1)]
    spans = substring_dedup.shared_passages(documents(spark, rows)).collect()
    assert {row.doc_id for row in spans} == set(range(40))


@pytest.mark.parametrize("text", [b"", b"a", b"  a b\tcc \nd", b" ".join([b"ab"] * 50)])
def test_words_before_each_place(text):
    found = substring_dedup.words_before(text).tolist()
    starts = [i for i in range(len(text)) if text[i : i + 1].split()
              and (i == 0 or not text[i - 1 : i].split())]
    assert found == [sum(s < i for s in starts) for i in range(len(text) + 1)]


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("least", [2, 3])
def test_rows_that_wait_are_bounded(spark, partitions, least):
    """Documents that hold a key very often, with enough other documents and without."""
    r = random.Random(33)
    rows = [(k, k, d, at) for k in range(6) for d in range(k) for at in range(r.choice([1, 400]))]
    rows += [(9, 9, 0, at) for at in range(3000)] + [(10, 10, d, 0) for d in range(3)]
    table = spark.createDataFrame(rows, "_k1 bigint, _k2 bigint, _doc bigint, _at bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = runs.shared_rows(
            table, ["_at"], least, False, partitions, lambda df: written(df, "waiting"), 120
        ).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = defaultdict(set)
    for k, _, d, _ in rows:
        docs[k].add(d)
    wanted = [(*row, row[2] != min(docs[row[0]])) for row in rows if len(docs[row[0]]) >= least]
    assert same(map(tuple, got)) == same(wanted)


def test_many_small_partitions_make_few_files(spark):
    """Each partition is still judged by itself, with a key over all of them and many inside."""
    cores = spark.sparkContext.defaultParallelism
    rows = [(0, 0, d, 0) for d in range(2000)] + [(k, k, d, 0) for k in range(1, 500) for d in (1, 2, 3)]
    table = spark.createDataFrame(rows, "_k1 bigint, _k2 bigint, _doc bigint, _at bigint")
    tables = []

    def write(df):
        tables.append(written(df, "many"))
        return tables[-1]

    got = runs.shared_rows(table, ["_at"], 3, True, 20 * cores, write).collect()
    assert len(tables) == 1 and len(tables[0].inputFiles()) <= 20 * cores // 8 + 1
    last = {k: 1999 if k == 0 else 3 for k in range(500)}
    assert same(map(tuple, got)) == same((*row, row[2] != last[row[0]]) for row in rows)


def test_partitions_follow_the_bytes(spark):
    docs = documents(spark, [(i, "x" * 1000, "en", "s", 0) for i in range(100)])
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions_for(docs, 1000) == 100
    assert partitions_for(docs, 10**9) == partitions_for(documents(spark, []), 1) == least


def test_cuts_resist_insertions():
    text = sentence(random.Random(1), 500).encode()
    before = set(substring_dedup.cuts(text).tolist())
    after = {c - 5 for c in substring_dedup.cuts(text[:1000] + b"again" + text[1000:]).tolist()}
    assert {c for c in before if c > 1000 + 150} == {c for c in after if c > 1000 + 150}


@pytest.mark.parametrize("text", [b"", b"a", b"a" * 100_000, bytes(range(256)) * 9000])
def test_chunks_cover_any_bytes(text):
    starts, ends = substring_dedup.chunks(text)
    assert all(ends - starts >= substring_dedup.LEAST_BYTES)
    assert all(ends - starts < 1 << 20)
    if len(starts) and len(text) > 3 * substring_dedup.MOST_GAP:
        assert starts[0] == 0
        assert max(starts[1:] - ends[:-1], default=0) <= 0


def test_odd_rows(spark):
    spans = substring_dedup.shared_passages(with_clashes(documents(spark))).collect()
    assert {row.doc_id for row in spans} == {5, 6}
    copies = documents(spark, [(None, sentence(random.Random(1), 90), "en", "s", 0)] * 3)
    assert substring_dedup.shared_passages(copies).collect() == []
