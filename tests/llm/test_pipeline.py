"""Every stage of the pipeline against brute force, and what is registered."""

import duckdb
import pandas as pd
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F
from samples import documents, same
from test_lines import brute as brute_lines
from test_native import brute_leaks
from test_simhash import fingerprint, roots

import __spark_entry__ as contract
import corpus_pipeline
from stallkeeper.llm import runs, toxicity
from stallkeeper.llm.queries import ORACLE_SQL, QUERIES

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents, and what each stage made of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        made.append(docs.collect())
    return made


def as_rows(found):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in found]


def test_toxic_documents_go_and_others_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = documents(spark, as_rows(stages[0]))
    judged = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert same(as_rows(stages[1])) == same(as_rows(r for r in judged if not r.toxic))
    assert 0 < len(stages[1]) < len(stages[0])


def test_lines_go(stages):
    import hashlib

    want = {r[0]: r for r in brute_lines(as_rows(stages[1]))}
    assert {r.doc_id for r in stages[2]} == set(want)
    for row in stages[2]:
        assert hashlib.sha256(row.text.encode()).hexdigest() == want[row.doc_id][3]


def test_one_of_each_group_stays(stages):
    prints = {r.doc_id: fingerprint(r.text) for r in stages[2]}
    root = roots(list(prints.values()), 2)
    first = {}
    for doc_id, p in prints.items():
        first[root[p]] = min(first.get(root[p], doc_id), doc_id)
    assert {r.doc_id for r in stages[3]} == set(first.values())
    assert len(stages[3]) == len(first)


def test_leaks_go(spark, stages):
    bench = [tuple(r) + (None,) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {d for d, *_, bad in brute_leaks(as_rows(stages[3]), bench) if not bad}
    assert {r.doc_id for r in stages[4]} == want


def test_tokens_decode_to_the_texts(stages):
    import hashlib

    digest = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in stages[4]}
    assert {r.doc_id: r.decoded_sha256 for r in stages[5]} == digest
    assert all(len(r.ids) == 4 * r.n_tokens for r in stages[5])


def test_columns_of_documents(stages):
    for made in stages[1:5]:
        assert made[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_chains_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).collect()
    assert same((r.doc_id, r.ids_sha256) for r in got) == same(
        (r.doc_id, r.ids_sha256) for r in stages[5]
    )


def test_empty_documents(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_query_for_each_operator():
    names = contract.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    folder = f"{TESTDATA}/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(contract.oracle_sql()[name])
    got = contract.queries()[name](spark, folder)
    assert got.columns == want.columns
    assert same(got.collect()) == same(want.fetchall())


@pytest.mark.parametrize("stage", ["toxicity", "line_dedup", "simhash", "byte_bpe"])
@pytest.mark.parametrize("given, most", [(None, 16), ("64m", 16), ("1m", 4)])
def test_workers_get_texts_by_bytes(spark, stage, given, most):
    """Texts of 256 KiB: each stage asks for 4 MiB at once, or for what the session has if less."""

    @F.pandas_udf("bigint")
    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 18).alias("text"))
    spark.conf.unset(key) if given is None else spark.conf.set(key, given)
    try:
        dict(corpus_pipeline.STAGES)[stage](spark, documents(spark), SF)
        assert texts.select(rows("text").alias("n")).agg(F.max("n")).first()[0] <= most + 1
    finally:
        spark.conf.unset(key)


def test_small_tables_of_the_driver_need_no_workers(spark):
    """A list of rows would be converted by Python workers, which stay beside those of the texts."""
    rows = [(1, 1, 5, 4, 2), (1, 1, 4, 3, 2), (2, 2, 9, 9, 1), (-3, 3, 2, 0, 3)]
    schema = "_k1 bigint, _k2 bigint, _doc bigint, _last bigint, _docs bigint"
    for found in (rows, []):
        settled = runs._settle(spark.createDataFrame(found, schema), 3, True)
        assert "ExistingRDD" not in settled._jdf.queryExecution().toString()
        assert settled.columns == ["_k1", "_k2", "_first"]
        assert same(settled.collect()) == same([(1, 1, 5), (-3, 3, 2)] if found else [])
