import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallkeeper.operators import selection
from stallkeeper.operators.ranking import bucket_end, in_global_order, with_rank
from stallkeeper.plans import advanced
from stallkeeper.plans.catalog import all_queries
from stallkeeper.plans.warehouse import testdata_warehouse as warehouse_of
from stallkeeper.sources.store import TableStore

SIZES = [0, 1, 3, 4, 6, 1003]
PARTITIONS = ["1", "3", "8"]


@pytest.fixture
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set(coalesce, "false")  # keep small inputs on several partitions
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset(coalesce)


@pytest.mark.parametrize("partitions", PARTITIONS, indirect=True)
@pytest.mark.parametrize("distinct_values", [1, 5])
@pytest.mark.parametrize("size", SIZES)
def test_same_as_built_in_windows(spark, tmp_path, partitions, distinct_values, size):
    df = spark.range(size).select(
        F.lpad(F.col("id").cast("string"), 6, "0").alias("id"),
        (F.col("id") * 7 % distinct_values).cast("decimal(12,2)").alias("v"),
    )
    order = [F.desc("v"), F.asc("id")]
    store = TableStore(spark, str(tmp_path))
    ranked = with_rank(store.table("ranked", lambda: in_global_order(df, order)), "v")
    everything = Window.orderBy(*order)
    running = everything.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    expected = df.select(
        "id", "v",
        F.row_number().over(everything).alias("rn"),
        F.lit(size).alias("n"),
        F.sum("v").over(running).alias("running_v"),
        F.sum("v").over(Window.partitionBy()).alias("total_v"),
    )
    columns = expected.columns
    assert sorted(ranked.select(*columns).collect()) == sorted(expected.collect())


@pytest.mark.parametrize("buckets", [1, 2, 4, 5])
def test_bucket_ends_match_ntile(spark, buckets):
    for size in SIZES[1:]:
        df = spark.range(size).withColumn(
            "bucket", F.ntile(buckets).over(Window.orderBy("id"))
        )
        last = {r.bucket: r.rank for r in df.groupBy("bucket").agg(
            (F.max("id") + 1).alias("rank")).collect()}
        ends = spark.range(1).select(
            *[bucket_end(b, buckets, F.lit(size).cast("bigint")) for b in range(1, buckets + 1)]
        ).first()
        assert [last.get(b, size) for b in range(1, buckets + 1)] == list(ends)


def people(spark, *rows):
    return spark.createDataFrame(
        rows,
        "customer_unique_id string, orders long, revenue decimal(18,2), "
        "last_purchase_ts timestamp_ntz",
    )


def rfm(customers, buckets=4, as_of=None):
    all_orders = customers.select(F.col("last_purchase_ts").alias("purchase_ts"))
    borders = advanced.rfm_borders(customers, buckets)
    return advanced.a4_rfm_scores(customers, borders, all_orders, buckets, as_of)


def keys(rows, values, ranks):
    """By sorting: a missing value last, a missing text first."""
    found = []
    for d, own in enumerate(ranks):
        order = sorted(
            (v[d] is None, v[d] or 0, text is not None, text or "", v[d]) for text, *v in rows
        )
        found.append([(order[r - 1][4], order[r - 1][3] if order[r - 1][2] else None) for r in own])
    return found


@pytest.mark.parametrize("bits, few", [(1, 1), (3, 5), (14, 1000)])
def test_keys_at_ranks(spark, monkeypatch, bits, few):
    monkeypatch.setattr(selection, "PART_BITS", bits)
    monkeypatch.setattr(selection, "FEW_ROWS", few)
    r = random.Random(bits)
    texts = ["", "a", "ab", "abc", "abcd", "b" * 9, "é", "\U0001f600", "\ue000", "ab" * 3]
    texts += [f"u{r.randrange(10**r.randrange(1, 9))}" for _ in range(300)]
    rows = [
        (text, r.choice([None, 1, 1, 1, 2]), r.randrange(-(10**17), 10**17), 5, None)
        for text in [None, *dict.fromkeys(texts)]
    ]
    df = spark.createDataFrame(rows, "t string, a long, b long, c long, d long").repartition(5)
    n = len(rows)
    ranks = [[1, n // 4, n // 2, n], [1, 7, n], list(range(1, 30)) + [n], [1, n // 3, n]]
    values = [F.col(c) for c in "abcd"]
    assert selection.keys_at_ranks(df, values, "t", ranks) == keys(rows, "abcd", ranks)
    with pytest.raises(ValueError, match="no ranks"):
        selection.keys_at_ranks(df, values, "t", [[n + 1], [], [], []])
    none = df.limit(0)
    assert selection.keys_at_ranks(none, values, "t", [[], [], [], []]) == [[]] * 4


def test_borders_are_found_without_a_sort(spark):
    w = warehouse_of(spark, f"{TESTDATA}/sf0.001")
    for plan in (w["rfm_borders"], all_queries()["a4_rfm_scores"](spark, f"{TESTDATA}/sf0.001")):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in text and "Sort" not in text and "Window" not in text


@pytest.mark.parametrize("size", [1, 2, 3, 4, 6, 103])
@pytest.mark.parametrize("buckets", [4, 5])
def test_rfm_scores_same_as_ntile(spark, size, buckets):
    customers = spark.range(size).select(
        F.when(F.col("id") > 0, F.concat(F.lit("u"), F.col("id"))).alias("customer_unique_id"),
        F.when(F.col("id") % 10 == 0, 2).otherwise(1).cast("bigint").alias("orders"),
        (F.col("id") * 37 % 11).cast("decimal(18,2)").alias("revenue"),
        F.when(
            F.col("id") % 13 != 5,
            F.expr("timestamp_ntz '2017-01-01 10:00:00' + make_dt_interval(cast(id * 5 % 17 as int), cast(id % 5 as int))"),
        ).alias("last_purchase_ts"),
    )
    person = F.asc_nulls_first("customer_unique_id")
    last_day = F.col("last_purchase_ts").cast("date")
    expected = customers.select(
        "customer_unique_id",
        F.ntile(buckets).over(Window.orderBy(last_day.asc_nulls_last(), person)).alias("r_score"),
        F.ntile(buckets).over(Window.orderBy("orders", person)).alias("f_score"),
        F.ntile(buckets).over(Window.orderBy("revenue", person)).alias("m_score"),
    )
    got = rfm(customers, buckets).select(*expected.columns)

    def by_person(df):
        return sorted(map(tuple, df.collect()), key=lambda r: r[0] or "")

    assert by_person(got) == by_person(expected)


def test_recency_counts_to_the_last_purchase_or_the_given_day(spark):
    customers = people(
        spark,
        ("a", 1, Decimal("1.00"), datetime(2017, 1, 1, 23, 0)),
        ("b", 1, Decimal("1.00"), datetime(2017, 1, 31, 1, 0)),
        ("c", 1, Decimal("1.00"), None),
    )

    def recency(**options):
        scores = rfm(customers, **options).collect()
        return {row.customer_unique_id: row.recency_days for row in scores}

    assert recency() == {"a": 30, "b": 0, "c": None}
    assert recency(as_of=date(2017, 2, 1)) == {"a": 31, "b": 1, "c": None}


def test_rfm_of_nobody(spark):
    assert rfm(people(spark)).collect() == []


def test_rfm_labels_first_match_wins(spark):
    scores = spark.createDataFrame(
        [("a", 3, 3, 3), ("b", 2, 4, 4), ("c", 4, 1, 4), ("d", 1, 3, 1), ("e", 1, 1, 1)],
        "customer_unique_id string, r_score long, f_score long, m_score long",
    ).withColumn("monetary", F.lit(Decimal("10.00")))
    by_person = scores.select("customer_unique_id").collect()
    labels = {
        row[0]: advanced.a4_rfm_segments(
            scores.where(F.col("customer_unique_id") == row[0])
        ).first().segment
        for row in by_person
    }
    assert labels == {
        "a": "Champions", "b": "At risk (high value, gone quiet)", "c": "New / Promising",
        "d": "Loyal", "e": "Others",
    }


def test_ranking_is_not_done_in_one_task(spark):
    df = spark.range(1000).withColumn("v", F.col("id").cast("decimal(12,2)"))
    plan = in_global_order(df, [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "SinglePartition" not in plan
