"""Plans and results under hot keys, which the test tables do not have."""

import re

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from stallkeeper.operators import cleaning, quality
from stallkeeper.plans import advanced, business, mart, warehouse
from stallkeeper.plans.catalog import all_queries
from stallkeeper.plans.warehouse import testdata_warehouse as warehouse_of
from stallkeeper.session import Sizing

LINES = 60_000


@pytest.fixture
def hot(spark):
    """A third of all lines in one order, of one product and from one seller."""
    third = F.col("id") % 3 == 0
    lines = spark.range(0, LINES, 1, 8).select(
        F.when(third, "o0").otherwise(F.concat(F.lit("o"), F.col("id") % 5000)).alias("order_id"),
        F.col("id").cast("int").alias("item_seq"),
        F.when(third, "p0").otherwise(F.concat(F.lit("p"), F.col("id") % 500)).alias("product_id"),
        F.when(third, "s0").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("seller_id"),
        F.lit(1).cast("decimal(12,2)").alias("price"),
        F.lit(1).cast("decimal(12,2)").alias("freight_value"),
        F.lit(2).cast("decimal(14,2)").alias("item_total"),
    )

    def ids(prefix, n, name):
        return spark.range(n).select(F.concat(F.lit(prefix), F.col("id")).alias(name))

    orders = ids("o", 5000, "order_id").select(
        "order_id", F.lit("c0").alias("customer_id"), F.lit("delivered").alias("order_status"),
        *[F.lit("2017-01-01").cast("timestamp_ntz").alias(c)
          for c in ("purchase_ts", "delivered_ts", "estimated_ts")],
        F.lit(0).alias("delivery_days"),
    )
    customers = ids("c", 10, "customer_id").select(
        "customer_id", F.lit("u").alias("customer_unique_id"), F.lit("SP").alias("state"),
        F.lit("x").alias("city"),
    )
    products = ids("p", 500, "product_id").withColumn("category", F.lit("toys"))
    sellers = ids("s", 50, "seller_id").withColumn("seller_state", F.lit("SP"))
    return lines, mart.placed_orders(orders, customers), products, sellers


@pytest.fixture
def shuffled_joins(spark):
    """As on big inputs: nothing is small enough to broadcast, hot partitions get split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def as_run(plan):
    """The plan without the initial plans, of subqueries either."""
    lines, below = [], None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" :+-"))
        if below is None or indent < below:
            below = indent if "== Initial Plan ==" in line else None
            lines.append(line)
    return "\n".join(lines)


def test_sales_lines_splits_hot_orders_products_and_sellers(shuffled_joins, hot):
    view = mart.sales_lines(*hot)
    assert len(view.collect()) == LINES
    skewed = re.findall(r"SortMergeJoin\(skew=true\) \[(\w+?)#", executed(view).split("Initial Plan")[0])
    assert set(skewed) >= {"order_id", "product_id", "seller_id"}


def test_reports_on_hot_keys(shuffled_joins, hot):
    view = mart.sales_lines(*hot)
    totals = mart.order_totals(view)
    customers = mart.customer_totals(totals)
    assert business.q1_kpis(customers).first().asDict() == {
        "delivered_orders": 5000, "unique_customers": 1, "items_sold": LINES,
        "product_revenue_brl": LINES, "freight_brl": LINES, "avg_order_value_brl": 12,
    }
    top = business.q4a_top_sellers(view).first()
    from_s0 = [i for i in range(LINES) if i % 3 == 0 or i % 50 == 0]
    assert (top.seller_id, top.revenue_brl) == ("s0", len(from_s0))
    assert top.orders == len({0 if i % 3 == 0 else i % 5000 for i in from_s0})
    assert business.q3_category_share(view).first().orders == 5000
    assert advanced.a3_top_seller_per_category(view).first().seller_id == "s0"


def test_references_are_counted_before_they_meet_parents(spark, shuffled_joins):
    w = warehouse_of(spark, f"{TESTDATA}/sf0.001")
    # The side of each anti join that has the references is an aggregate: one row per
    # key, so very many rows pointing at one missing parent do not make a hot task.
    plan = executed(quality.check_foreign_keys(w.staging, w)).splitlines()
    for at, line in enumerate(plan):
        if "LeftAnti" in line:
            below = next(x for x in plan[at + 1 :] if re.search(r"Aggregate|FileScan|Window", x))
            assert "Aggregate" in below


@pytest.mark.parametrize("table", ["fact_orders", "fact_order_items"])
def test_facts_cut_from_the_joined_tables_are_the_checked_facts(spark, table):
    w = warehouse_of(spark, f"{TESTDATA}/sf0.01")
    checked = {
        "fact_orders": lambda: cleaning.fact_orders(w.staging["stg_orders"], w["dim_customers"]),
        "fact_order_items": lambda: cleaning.fact_order_items(
            w.staging["stg_order_items"], w["fact_orders"], w["dim_products"], w["dim_sellers"]
        ),
    }[table]()
    assert w[table].columns == checked.columns
    assert sorted(map(str, map(tuple, w[table].collect()))) == sorted(
        map(str, map(tuple, checked.collect()))
    )


CHECKS = {
    "check_foreign_keys": 1, "check_primary_keys": 1, "check_not_null": 1, "dq_profile": 1,
    "reconcile_counts": 1, "staging_counts": 0, "loss_ledger": 1, "check_files": 1,
    "check_lengths": 1,
}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_checks_read_the_items_once_per_stage(spark, shuffled_joins, name):
    """Staging is read as it was written once, not bound again for each check."""
    plan = executed(all_queries()[name](spark, f"{TESTDATA}/sf0.001")).split("Initial Plan")[0]
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert not any("lineitem.parquet" in line for line in scans)
    assert sum("/stg_order_items" in line for line in scans) <= CHECKS[name]
    assert sum("/sales_lines" in line for line in scans) <= CHECKS[name]


@pytest.mark.parametrize(
    "name", ["q3_category_share", "q5a_status_mix", "q7_payment_mix", "q8_loyalty"]
)
def test_shares_of_the_whole_need_one_scan_and_no_window(spark, name):
    found = all_queries()[name](spark, f"{TESTDATA}/sf0.001")
    found.collect()
    plan = executed(found)
    assert "Window" not in plan
    assert "ubquery" in plan
    ran = as_run(plan)
    assert "ReusedExchange" in ran and ran.count("FileScan") == 1


def test_default_settings_split_a_hot_order(spark):
    """The factor stays as it is; only sizes follow the small test data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "64",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        lines = spark.range(0, LINES, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
            F.sha2(F.col("id").cast("string"), 256).alias("v"),
        )
        joined = lines.join(spark.range(LINES).withColumnRenamed("id", "k"), "k")
        assert len(joined.collect()) == LINES
        assert "skew=true" in executed(joined).split("Initial Plan")[0]
    finally:
        for key in settings:
            spark.conf.unset(key)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_plans_have_no_python_and_no_cross_joins(spark, name):
    plan = executed(all_queries()[name](spark, f"{TESTDATA}/sf0.001"))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "MapIn"):
        assert bad not in plan


INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_shuffle_partitions_follow_the_input_alone(spark):
    before = spark.conf.get(INITIAL, None)
    large = Sizing(spark, 100 << 40).apply()
    assert spark.conf.get(INITIAL) == str(large.partitions) == "409600"
    small = Sizing(spark, 1 << 20).apply()
    assert spark.conf.get(INITIAL) == str(small.partitions)
    assert small.partitions == int(spark.conf.get("spark.sql.shuffle.partitions"))
    small.restore()
    assert spark.conf.get(INITIAL) == "409600"
    large.restore()
    assert spark.conf.get(INITIAL, None) == before
    large.restore()  # nothing left to put back
    assert spark.conf.get(INITIAL, None) == before


def test_sizing_parameters(spark):
    assert Sizing(spark, 1 << 40, bytes_per_partition=1 << 30).partitions == 1024
    assert Sizing(spark, 1 << 40, most=1000).partitions == 1000
    assert Sizing(spark, (1 << 40) + 1).partitions == 4097


SCAN = "spark.sql.files.maxPartitionBytes"


def test_scan_tasks_are_small_or_as_small_as_the_session_has_them(spark):
    before = spark.conf.get(SCAN)
    sizing = Sizing(spark, 1 << 20).apply()
    assert spark.conf.get(SCAN) == str(16 << 20)
    sizing.restore()
    assert spark.conf.get(SCAN) == before
    spark.conf.set(SCAN, "1m")
    try:
        smaller = Sizing(spark, 1 << 20).apply()
        assert spark.conf.get(SCAN) == str(1 << 20)
        smaller.restore()
    finally:
        spark.conf.unset(SCAN)


def test_parquet_input_gets_more_partitions_than_text_of_as_many_bytes(spark, monkeypatch):
    monkeypatch.setattr(warehouse, "source_state", lambda *_: ("as if large", 6 << 30))
    w = warehouse_of(spark, f"{TESTDATA}/sf0.001")
    try:
        assert w.sizing.partitions == w._buckets("sales_lines").count == 768
    finally:
        w.close()
        warehouse._by_source.pop((spark.sparkContext.applicationId, "as if large"))


def test_reports_read_only_their_columns_and_push_the_status_down(spark):
    plan = executed(all_queries()["q3_category_share"](spark, f"{TESTDATA}/sf0.001"))
    assert "EqualTo(order_status,delivered)" in plan
    assert "ReadSchema: struct<order_id:string,order_status:string,category:string,price" in plan
    assert "item_total" not in plan and "Join" not in plan
