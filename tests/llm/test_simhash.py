"""Fingerprints and components against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F
from samples import documents, lowered, odd_rows, same, sentence, with_clashes

from stallkeeper.llm import simhash
from stallkeeper.llm.components import components
from stallkeeper.llm.queries import op4_simhash
from stallkeeper.llm.scratch import written


def fingerprint(text) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints: list[int], most: int) -> dict[int, int]:
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                high, low = max(find(a), find(b)), min(find(a), find(b))
                root[high] = low
    return {p: find(p) for p in distinct}


def brute(rows, most=2):
    prints = [fingerprint(text) for _, text, *_ in rows]
    root = roots(prints, most)
    first = {}
    for (doc_id, *_), p in zip(rows, prints, strict=True):
        if doc_id is not None:
            first[root[p]] = min(first.get(root[p], doc_id), doc_id)
    for (doc_id, *_), p in zip(rows, prints, strict=True):
        yield doc_id, f"{p:016x}", first.get(root[p])


def near_copies(r, count):
    base = sentence(r, 400).split()
    for i in range(count):
        words = list(base)
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = "other"
        yield (500 + i, " ".join(words), "en", "s", 0)


@pytest.mark.parametrize("most_paired", [64, 1])
def test_documents(spark, tmp_path, monkeypatch, most_paired):
    monkeypatch.setattr(simhash, "MOST_PAIRED", most_paired)
    rows = odd_rows() + list(near_copies(random.Random(2), 60))
    with_clashes(documents(spark, rows)).write.parquet(f"{tmp_path}/documents.parquet")
    got = op4_simhash(spark, str(tmp_path)).collect()
    assert same(got) == same(brute(rows))
    assert len({row.component_id for row in got}) < len({row.fingerprint for row in got})


@pytest.mark.parametrize("most_bits", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("most_paired", [64, 1])
def test_links_of_close_numbers(spark, monkeypatch, most_bits, most_paired):
    monkeypatch.setattr(simhash, "MOST_PAIRED", most_paired)
    r = random.Random(most_bits)
    prints = {r.getrandbits(64) for _ in range(10)} | {0, (1 << 64) - 1, 1 << 63}
    for _ in range(150):
        changed = r.choice(sorted(prints))
        for _ in range(r.randrange(1, 5)):
            changed ^= 1 << r.randrange(64)
        prints.add(changed)
    signed = [(p - (1 << 64) * (p >> 63),) for p in prints]
    fps = spark.createDataFrame(signed, "_fp bigint")
    got = {row["_fp"]: row["_root"] for row in simhash._roots(fps, most_bits).collect()}
    want = roots(sorted(prints), most_bits)
    groups, wanted = {}, {}
    for p in prints:
        groups.setdefault(got[p - (1 << 64) * (p >> 63)], set()).add(p)
        wanted.setdefault(want[p], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)]
    edges += [(5, 5), (7, 6), (7, 6), (2000, 1999)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in components(frame, lambda df: written(df, "test")).collect()}
    want = {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)} | {2000: 1999}
    assert got == want


def test_keeps_one_of_each_group(spark):
    rows = odd_rows() + list(near_copies(random.Random(2), 30))
    kept = simhash.keep_one(with_clashes(documents(spark, rows)), 3, 2)
    assert kept.columns == with_clashes(documents(spark, rows)).columns
    ids = [row.doc_id for row in kept.select("doc_id").collect()]
    groups = {}
    prints = {i: fingerprint(t) for i, t, *_ in rows}
    root = roots([fingerprint(t) for _, t, *_ in rows], 2)
    for doc_id, text, *_ in rows:
        groups.setdefault(root[fingerprint(text)], []).append(doc_id)
    want = [min(g, key=lambda i: (i is not None, i or 0)) for g in groups.values()]
    assert sorted(ids, key=repr) == sorted(want, key=repr)
    assert prints


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, []), 3, 2).collect() == []
    assert simhash.keep_one(documents(spark, []), 3, 2).count() == 0


def test_hex_of_high_bits(spark):
    row = spark.range(1).select(F.lpad(F.lower(F.hex(F.lit(-(1 << 63)))), 16, "0").alias("h")).first()
    assert row.h == "8" + "0" * 15
