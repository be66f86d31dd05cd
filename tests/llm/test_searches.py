"""Vector codes, nearest neighbours and lexical search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from samples import documents, lowered, odd_rows, same, sentence, with_clashes

from stallkeeper.llm import lexical_search, neighbours, sql, vector_codes
from stallkeeper.llm.queries import op11_vector_codes, op12_neighbours, op13_lexical_search

VECTORS = "vec_id bigint, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vectors(count, size=32, seed=1, spread=1.0):
    """Clusters of vectors, equal ones, and rows that take no part."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, size))
    rows = []
    for i in range(count):
        v = centres[i % 5] + spread * r.normal(size=size)
        label = None if i % 11 == 0 else i % 4
        rows.append((i, [float(np.float32(x)) for x in v], label))
    rows += [(count + i, rows[3][1], 2) for i in range(count // 3 * (count > 3))]  # a third
    bad = [None, [], [0.5] * (size - 1) + [NAN], [INF] + [0.5] * (size - 1), [None] + [0.5] * (size - 1)]
    rows += [(-5 + i, v, 1) for i, v in enumerate(bad)]
    return rows


def usable(rows):
    return [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def clashing(df):
    return df.selectExpr(
        "*", "1 AS v", "2 AS list", "3 AS block", "4 AS code", "5 AS error", "6 AS `a.b`", "7 AS n"
    )


# Vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(usable(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([r[1] for r in kept]) * 256).astype(np.int64)
    cut = x.reshape(len(x), parts, -1)
    books = cut[:entries].copy()

    def nearest():
        far = ((cut[:, None] - books[None]) ** 2).sum(axis=3)
        return far.argmin(axis=1), far.min(axis=1)

    for _ in range(rounds):
        best, _ = nearest()
        for p in range(parts):
            for e in range(len(books)):
                own = cut[best[:, p] == e, p]
                if len(own):
                    books[e, p] = own.sum(axis=0) // len(own)
    best, far = nearest()
    errors = far.sum(axis=1)
    by_label = Counter()
    for row, error in zip(kept, errors, strict=True):
        by_label[row[2]] += int(error)
    digits = ",".join(map(str, books.swapaxes(0, 1).ravel().tolist()))
    digest = hashlib.sha256(digits.encode()).hexdigest()
    return [
        (row[0], bytes(b.astype(np.uint8)).hex(), int(e), by_label[row[2]], digest)
        for row, b, e in zip(kept, best, errors, strict=True)
    ]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_codes_are_those_of_comparing_all(spark, tmp_path, monkeypatch, spread):
    monkeypatch.setattr(vector_codes, "CHUNK", 300)
    rows = vectors(1500, spread=spread)
    rows += [rows[7], (None, rows[8][1], None), (7, rows[9][1], 3)]
    clashing(frame(spark, rows)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op11_vector_codes(spark, str(tmp_path))
    assert same(got.collect()) == same(brute_codes(rows))


def test_codes_agree_with_sql(spark, tmp_path):
    rows = vectors(200, size=32)
    path = f"{tmp_path}/embeddings.parquet"
    frame(spark, rows).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    found = db.sql(sql.VECTOR_CODES)
    got = op11_vector_codes(spark, str(tmp_path)).select(*found.columns)
    assert same(got.collect()) == same(found.fetchall())


@pytest.mark.parametrize("count", [0, 1, 5, 70])
def test_codes_of_few_vectors(spark, count):
    rows = vectors(count)[:count]
    codes = vector_codes.encode(frame(spark, rows))
    got = vector_codes.with_label_errors(codes).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256"
    )
    assert same(got.collect()) == (same(brute_codes(rows)) if rows else [])


def test_balls_skip_most_comparisons():
    """Most parts of clustered vectors are owned by whole balls."""
    rows = usable(vectors(2000, spread=0.05))
    points = np.floor(np.array([r[1] for r in rows]) * 256).astype(np.int64)[:, :2]
    tree = vector_codes._tree_columns(points)
    assert sorted(tree["place"]) == list(range(len(points)))
    search = vector_codes._Search(tree, points[:5])
    counts, sums = search.totals()
    assert counts.sum() == len(points) and (sums.sum(axis=0) == points.sum(axis=0)).all()
    single = sum(len(places) for places, _ in search.single)
    assert single < len(points) / 4


def test_codes_refuse_what_cannot_be_cut(spark):
    with pytest.raises(ValueError, match="cannot be cut"):
        vector_codes.encode(frame(spark, [(1, [0.5] * 20, 1)]))
    with pytest.raises(ValueError, match="not supported"):
        vector_codes.encode(frame(spark, [(1, [1e30] * 16, 1)]))
    mixed = [(2, [0.5] * 32, 1), (1, [0.5] * 16, 1), (3, [0.25] * 16, 1)]
    coded = vector_codes.encode(frame(spark, mixed)).coded.collect()
    assert sorted(r.vec_id for r in coded) == [1, 3]


# Nearest neighbours


def brute_neighbours(rows, k=10):
    kept = sorted(
        {(i, tuple(v)) for i, v, _ in usable(rows) if i is not None and any(v)}
    )
    kept = [row for row in kept if len(row[1]) == len(kept[0][1])]
    ids, x = np.array([i for i, _ in kept]), np.array([v for _, v in kept])
    found = {}
    for at, (i, _) in enumerate(kept):
        if i % 100 == 0:
            far = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, far)) if j != at][:k]
            found[i] = [(int(ids[j]), far[j]) for j in order]
    return found


def neighbour_rows(spark, folder, rows):
    clashing(frame(spark, rows)).write.parquet(f"{folder}/embeddings.parquet")
    got = {}
    for row in op12_neighbours(spark, str(folder)).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    return got


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_recall(spark, tmp_path, monkeypatch, spread):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 40)
    monkeypatch.setattr(neighbours, "LIST_BLOCK", 32)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    rows = vectors(3000, spread=spread)
    rows += [rows[7], (9000, [0.0] * 32, 1), (None, rows[8][1], None), (9001, [0.5] * 31, 1)]
    got, want = neighbour_rows(spark, tmp_path, rows), brute_neighbours(rows)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    x = {i: np.array(v) for i, v, _ in usable(rows)}
    for q, found in got.items():
        assert q not in [i for i, _ in found]
        assert found == sorted(found, key=lambda f: (f[1], f[0]))
        for i, score in found:
            assert score == pytest.approx(np.sqrt(((x[i] - x[q]) ** 2).sum()), abs=1e-12)


def test_equal_vectors_give_the_lowest_ids(spark, tmp_path):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(1000, 0, -1)] + [(200, [1.0, 2.0, 3.5], 0)]
    got = neighbour_rows(spark, tmp_path, rows)
    lowest = [(i, 0.0) for i in range(1, 11)]
    assert all(got[q] == lowest for q in range(300, 1001, 100))
    # Two vectors have the id 200; each is a query of its own.
    far = [(i, 0.5) for i in range(1, 11)]
    assert sorted(got[200]) == sorted(lowest + far)


@pytest.mark.parametrize("count", [0, 1, 3])
def test_few_neighbours(spark, tmp_path, count):
    rows = [(100 * i, [1.0 + i, 2.0], 0) for i in range(count)]
    got = neighbour_rows(spark, tmp_path, rows)
    assert got == {q: f for q, f in brute_neighbours(rows).items() if f}


# Lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute_search(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(size for *_, size in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    found = []
    for item, text in sorted(set(items), key=repr):
        asked = Counter(terms(text))
        scored = []
        for d, c, size in counted:
            m = 25 + 75 * size * n // total
            score = sum(
                q
                * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t, q in asked.items()
                if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1):
            found.append((item, rank, d, -score))
    return found


def written_tables(spark, folder, rows, items):
    with_clashes(documents(spark, rows)).write.parquet(f"{folder}/documents.parquet")
    items = spark.createDataFrame(items, "item_id bigint, text string").selectExpr(
        "*", "1 AS doc_id", "2 AS terms", "3 AS score"
    )
    items.write.parquet(f"{folder}/benchmark.parquet")


def sample_items(r, count):
    items = [(i, sentence(r, r.randrange(1, 40))) for i in range(count)]
    return items + [
        (count, "the the THE of naïve été x́ \U0001f600"), (count, "in and to"), (3, None),
        (4, " \n"), (None, "theof andin"), items[0], (count + 1, "unheard-of"),
    ]


@pytest.mark.parametrize("block", [lexical_search.BLOCK_POSTINGS, 40])
def test_search_finds_the_best(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(lexical_search, "FIRST_VISITS", 2)
    monkeypatch.setattr(lexical_search, "PASS_TERMS", 300)
    r = random.Random(3)
    rows = odd_rows() + [(100 + i, sentence(r, r.choice([3, 20, 60])), "en", "s", 0) for i in range(400)]
    rows += [(900, rows[-1][1], "en", "s", 0)] * 15  # one row many times
    items = sample_items(r, 12)
    written_tables(spark, tmp_path, rows, items)
    want = brute_search([row[:2] for row in rows], items)
    assert same(op13_lexical_search(spark, str(tmp_path)).collect()) == same(want)


def test_search_agrees_with_sql(spark, tmp_path):
    r = random.Random(4)
    rows = odd_rows()[3:] + [(100 + i, sentence(r, 30), "en", "s", 0) for i in range(100)]
    written_tables(spark, tmp_path, rows, sample_items(r, 5))
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = db.sql(sql.LEXICAL_SEARCH)
    got = op13_lexical_search(spark, str(tmp_path)).select(*found.columns)
    assert same(got.collect()) == same(found.fetchall())


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "s", 0)], [(1, "the word", "en", "s", 8)]])
@pytest.mark.parametrize("items", [[], [(1, None)], [(1, "the")]])
def test_search_of_little(spark, tmp_path, rows, items):
    written_tables(spark, tmp_path, rows, items)
    want = brute_search([row[:2] for row in rows], items)
    assert same(op13_lexical_search(spark, str(tmp_path)).collect()) == same(want)


def test_exact_sums_beyond_doubles(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "_EXACT", 0.0)
    rows = [(i, f"a{i % 3} b{i % 5} c{i} a{i % 3}", "en", "s", 0) for i in range(30)]
    items = [(1, "a1 b2 c7 a1")]
    index = lexical_search.build(documents(spark, rows))
    got = lexical_search.search(index, spark.createDataFrame(items, "item_id bigint, text string"))
    assert same(got.collect()) == same(brute_search([row[:2] for row in rows], items))
