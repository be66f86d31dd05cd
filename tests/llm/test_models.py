"""Language identification and toxicity: held-out accuracy, odd tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import TESTDATA
from samples import documents, odd_rows, sentence, with_clashes

from stallkeeper.llm import language_id, toxicity
from stallkeeper.llm.queries import op3_language_id, op8_toxicity
from stallkeeper.llm.scratch import written

SF = f"{TESTDATA}/sf0.01"


def test_language_of_held_out_documents(spark):
    found = op3_language_id(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(found) == len(docs)
    for row in found:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1
    held_out = [row for row in found if row.held_out]
    right = [row.lang_pred == docs[row.doc_id].lang for row in held_out]
    assert np.mean(right) >= 0.97
    sure = [r for r, row in zip(right, held_out, strict=True) if not row.rejected]
    assert np.mean(sure) >= 0.99


def test_language_sees_text_alone(spark, tmp_path):
    """Held-out labels, sources and ids change no prediction."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).toPandas()
    held_out = docs["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    spark.createDataFrame(docs).write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.loc[held_out, "lang"] = "xx"
    docs["source"] = "elsewhere"
    spark.createDataFrame(docs).write.parquet(f"{tmp_path}/b/documents.parquet")
    a, b = (op3_language_id(spark, f"{tmp_path}/{d}").orderBy("doc_id").collect() for d in "ab")
    assert a == b


def test_language_of_odd_rows(spark):
    docs = with_clashes(documents(spark))
    model = language_id.fit(docs)
    found = language_id.identify(docs, model)
    assert found.columns == [
        *(c for c in docs.columns if c != "score"), "lang_pred", "score", "rejected"
    ]
    for row in found.select("text", "lang_pred", "score").collect():
        if not any(c.isalpha() for c in row.text or ""):
            assert (row.lang_pred, row.score) == ("und", 0)
        else:
            assert row.lang_pred in {"en", "fr"}


def test_language_without_documents(spark):
    none = documents(spark, [])
    model = language_id.fit(none)
    assert language_id.identify(none, model).collect() == []
    assert {r.lang_pred for r in language_id.identify(documents(spark), model).collect()} == {"und"}


def test_no_language_is_lost_by_copies_or_size(spark, monkeypatch):
    """Many copies of few texts, and languages of one short text, keep their dictionaries."""
    monkeypatch.setattr(language_id, "SAMPLE_DOCUMENTS", 16)
    seen = []
    monkeypatch.setattr(
        language_id, "written", lambda df, name: seen.append(written(df, name)) or seen[-1]
    )
    for seed in range(3):
        r = random.Random(seed)
        rows = [(0, f"{sentence(r, 30)} {i}", "en", "s", 0) for i in range(20) for _ in range(50)]
        rows += [(0, f"{sentence(r, 30)} {i}", "es", "s", 0) for i in range(300)]
        rows += [(0, "ß", "xx", "s", 0), (0, "no", "yy", "s", 0), (0, "12", "zz", "s", 0)]
        model = language_id.fit(documents(spark, rows))
        assert list(model.dictionaries)[:2] == ["en", "es"]
        assert set(model.dictionaries) == {"en", "es", "xx", "yy"}
        assert min(map(len, model.dictionaries.values())) >= 8
        found = dict(seen[-1].groupBy("lang").count().collect())
        assert found == {"en": 16, "es": 16, "xx": 1, "yy": 1}
        assert model.classifier()("ß")[0] in model.dictionaries


def test_narrow_margins_are_marked():
    model = language_id.Model({"aa": b"abcdefgh " * 50, "bb": b"zyxwvuts " * 50})
    classify = model.classifier()
    assert classify("abcdefgh abcdefgh bcdefgha abcd") [0::2] == ("aa", False)
    assert classify("zyxwvuts zyxwvuts zyxwvu")[0::2] == ("bb", False)
    assert classify("mmm")[2]


def test_toxic_documents_are_found(spark):
    found = {r.doc_id: r for r in op8_toxicity(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    caught = [found[r.doc_id].toxic for r in labels if r.toxic]
    spared = [not found[r.doc_id].toxic for r in labels if not r.toxic]
    assert np.mean(caught) >= 0.7
    assert np.mean(spared) >= 0.97
    assert all(0 <= r.severity <= toxicity.GRADES for r in found.values())


def planted(r, count, first):
    bad = ["vileword", "foulword", "crudeword", "rankword"]
    for i in range(count):
        text = sentence(r, r.randrange(20, 200)).split()
        toxic = i % 4 == 0
        for _ in range(r.randrange(1, 9) * toxic):
            text.insert(r.randrange(len(text)), r.choice(bad))
        yield (first + i, " ".join(text), "en", "s", 0), int(toxic)


def test_held_out_toxicity_and_rising_severity(spark):
    r = random.Random(12)
    known, held_out = list(planted(r, 400, 0)), list(planted(r, 400, 1000))
    labels = spark.createDataFrame(
        [(row[0], 1, t) for row, t in known], "doc_id bigint, quality int, toxic int"
    )
    docs = documents(spark, [row for row, _ in known + held_out])
    model = toxicity.fit(with_clashes(docs), labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    truth = {row[0]: t for row, t in held_out}
    found = [x for x in toxicity.score(with_clashes(docs), model).collect() if x.doc_id in truth]
    assert np.mean([x.toxic == bool(truth[x.doc_id]) for x in found]) >= 0.97
    mild, severe = model.severity("vileword and more"), model.severity("vileword foulword " * 5)
    assert mild[0] < severe[0]


@pytest.mark.parametrize("copies", [1, 300])
def test_rows_of_the_fit_are_bounded(spark, monkeypatch, copies):
    """An id that is labelled brings each of its texts once, and all ids no more than the bound."""
    monkeypatch.setattr(toxicity, "MOST_ROWS", 120)
    names = []

    def noting(df, name, *more):
        names.append((name, written(df, name, *more)))
        return names[-1][1]

    monkeypatch.setattr(toxicity, "written", noting)
    r = random.Random(2)
    rows = [row for row, _ in planted(r, 40, 0)]
    rows += [(0, sentence(r, 20) if copies == 1 else rows[0][1], "en", "s", 0) for _ in range(500)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(documents(spark, rows), labels)
    counts = {name: df.count() for name, df in names}
    assert counts["labelled-features"] == (120 if copies == 1 else 40)
    assert model.severity("vileword foulword " * 5)[0] >= 0


def test_features_leave_the_worker_in_bounded_batches(monkeypatch):
    """However many texts come at once, features of few of them are held at a time."""
    monkeypatch.setattr(toxicity, "BATCH_FEATURES", 500)
    r = random.Random(5)
    texts = [sentence(r, r.randrange(60)) for _ in range(400)] + [None, "", "Straße straßen", " 12 "]
    toxic = [i % 3 == 0 for i in range(len(texts))]
    given = pa.RecordBatch.from_pydict({"text": texts, "_toxic": toxic})
    found = list(toxicity.feature_batches(iter([given, given.slice(0, 0), given.slice(1, 2)])))
    longest = max(len(toxicity.feature_counts(text)) for text in texts)
    assert max(len(batch["found"].flatten()) for batch in found) < 500 + longest
    rows = [row for batch in found for row in batch.to_pylist()]
    expected = [*zip(texts, toxic, strict=True), *zip(texts[1:3], toxic[1:3], strict=True)]
    assert [row["_toxic"] for row in rows] == [mark for _, mark in expected]
    assert [[(x["feature"], x["n"]) for x in row["found"]] for row in rows] == [
        list(toxicity.feature_counts(text).items()) for text, _ in expected
    ]


@pytest.mark.parametrize("marks", [[], [(1, 1, 0), (2, 0, 0)], [(None, 1, 1), (3, 1, None)]])
def test_toxicity_without_examples(spark, marks):
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    docs = with_clashes(documents(spark))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    assert scored.columns == [*docs.columns, "severity", "toxic"]
    got = scored.collect()
    assert len(got) == len(odd_rows())
    assert not any(row.toxic for row in got)
    assert toxicity.score(documents(spark, []), toxicity.fit(docs, labels)).collect() == []


def test_cumulative_links_order_grades():
    """One weight, three ordered thresholds: recovered from drawn grades."""
    r = np.random.default_rng(2)
    x = r.normal(size=4000)
    latent = 2 * x + r.logistic(size=4000)
    grades = np.digitize(latent, [-1.0, 1.0, 3.0])
    rows = [np.array([0])] * 4000
    values = [np.array([v]) for v in x]
    weights, thresholds = toxicity.fit_cumulative(
        rows, values, grades, 1, balanced=False, penalty=0
    )
    assert weights[0] == pytest.approx(2, abs=0.25)
    assert thresholds == pytest.approx([-1, 1, 3], abs=0.35)
