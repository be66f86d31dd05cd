"""Orders, lines and payments dealt alike by order: joins without exchanges, hot orders spread."""

import re
from decimal import Decimal
from threading import Barrier

import pytest
from conftest import TESTDATA
from frames import rows, staging
from pyarrow.parquet import ParquetFile
from pyspark.sql import functions as F
from test_files import raw  # noqa: F401
from test_scale import executed

from stallkeeper.operators import buckets as dealing
from stallkeeper.operators import quality
from stallkeeper.operators.buckets import Buckets, dealt, dealt_orders, hot_orders
from stallkeeper.plans import business
from stallkeeper.plans.catalog import all_queries
from stallkeeper.plans.warehouse import Warehouse
from stallkeeper.plans.warehouse import testdata_warehouse as warehouse_of
from stallkeeper.sources import store
from stallkeeper.sources.store import TableStore


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def w(spark, no_broadcast):
    return warehouse_of(spark, f"{TESTDATA}/sf0.001")


def initial(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def exchanges(df):
    return re.findall(r"Exchange (\w+\(.*\), [A-Z_]+)", initial(df))


DEALT = ["order_id", "order_salt"]


@pytest.mark.parametrize("child", ["sales_lines", "fact_payments"])
@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti", "left"])
def test_stored_children_meet_orders_without_an_exchange(w, child, how):
    joined = w.dealt(child).select(*DEALT, F.lit(1)).join(
        w.order_places().select(*DEALT, "customer_id"), DEALT, how
    )
    assert "SortMergeJoin" in initial(joined) and exchanges(joined) == []
    count = {"left_anti": 0}.get(how, w[child].count())
    assert joined.count() == count


@pytest.mark.parametrize("name", ["q3_category_share", "q4a_top_sellers", "q4b_top_categories"])
def test_distinct_orders_are_counted_where_they_lie(spark, no_broadcast, name):
    """What is shuffled has a row for each group and task, none for each order."""
    found = all_queries()[name](spark, f"{TESTDATA}/sf0.001")
    assert not any("order_id" in x or "order_salt" in x for x in exchanges(found))
    assert "Bucketed: true" in initial(found)


@pytest.mark.parametrize("name", ["sales_lines", "fact_payments"])
def test_builds_move_no_order_and_each_child_once(w, name):
    """What is shuffled by order is the child, to be written; the orders stay where they are."""
    built = w._builders[name]()
    by_order = [x for x in exchanges(built) if "order_salt" in x]
    assert len(by_order) == 1 and "REPARTITION" in by_order[0]
    assert initial(built).count("Bucketed: true") == 1  # the orders


@pytest.mark.parametrize("table", ["fact_orders", "fact_order_items", "fact_payments"])
def test_key_checks_of_clean_tables_need_no_exchange(w, table):
    keys = {"fact_orders": ("order_id",), "fact_order_items": ("order_id", "item_seq"),
            "fact_payments": ("order_id", "payment_seq")}[table]
    df = w.star_as_dealt()[table]
    repeated = df.groupBy(*quality.with_salt(df, keys)).count().where("count > 1")
    assert exchanges(repeated) == [] and repeated.count() == 0


def test_reference_checks_of_clean_children_need_no_exchange(w):
    found = quality.check_foreign_keys(w.staging, w.star_as_dealt(), w.order_places())
    plan = initial(found)
    joins = [at for at, line in enumerate(plan.splitlines()) if "[order_id" in line and "LeftAnti" in line]
    assert len(joins) == 2
    assert not any("order_salt" in x for x in exchanges(found))
    plain = quality.check_foreign_keys(w.staging, w)
    assert sorted(rows(found)) == sorted(rows(plain))


def test_a_later_session_finds_the_buckets(spark, no_broadcast, tmp_path, raw):  # noqa: F811
    folder = str(tmp_path / "warehouse")
    loaded = Warehouse.from_files(spark, raw, folder)
    with Warehouse.open(spark, folder) as opened:
        joined = opened.dealt("sales_lines").join(opened.order_places().select(*DEALT), DEALT)
        assert exchanges(joined) == []
        assert joined.count() == loaded["sales_lines"].count()
    assert [t for t in spark.catalog.listTables() if t.name.startswith("stallkeeper")] == []


def test_other_names_than_sparks_own_survive(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "a folder"))
    df = spark.range(50).selectExpr("id AS `a b`", "CAST(id AS STRING) AS order_id", "1 AS order_salt")
    written = store.replace("t", df.repartition(4, *DEALT), buckets=Buckets(4))
    again = TableStore(spark, str(tmp_path / "a folder")).existing("t")
    assert sorted(rows(written)) == sorted(rows(again)) == sorted(rows(df))


def hot_lines(spark, n=6000):
    order = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("o"), F.col("id") % 500))
    return spark.range(0, n, 1, 8).select(order.alias("order_id"), F.col("id").alias("seq"))


def test_a_third_of_all_rows_in_one_order_is_spread(spark, no_broadcast, tmp_path):
    lines = hot_lines(spark)
    hot = hot_orders([lines, lines.limit(10)], 16, least_rows=100)
    assert rows(hot) == [("hot", 6)]
    assert hot_orders([lines], 16).count() == 0  # too few rows to be worth it
    spread = dealt(lines, "seq", hot, 16)
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 6000 / 3 / 2
    orders = dealt_orders(lines.select("order_id").distinct(), hot, 16)
    assert orders.where("order_id = 'hot'").count() == 6
    store = TableStore(spark, str(tmp_path))
    both = [
        store.replace(name, df, buckets=Buckets(16))
        for name, df in (("lines", spread), ("orders", orders))
    ]
    joined = both[0].join(both[1], DEALT)
    assert exchanges(joined) == [] and joined.count() == 6000
    assert dealing.once(both[1]).count() == 501


def test_an_order_in_several_buckets_is_one_order(spark):
    values = [
        ("o1", 0, "toys", "s1"), ("o1", 0, "toys", "s1"), ("o1", 0, "food", "s2"),
        *[("hot", salt, "toys", f"s{salt % 2}") for salt in (1, 2, 3, 3)], ("hot", 4, "food", "s2"),
        ("o2", 0, None, "s1"),
    ]
    lines = spark.createDataFrame(
        [(*v, "delivered", "SP", Decimal("1.00")) for v in values],
        "order_id string, order_salt int, category string, seller_id string, order_status string, "
        "seller_state string, price decimal(12,2)",
    )
    for given in (lines, lines.drop("order_salt")):
        per_category = business.q3_category_share(given)
        assert sorted(rows(per_category, "category", "orders", "items_sold"), key=str) == [
            ("food", 2, 2), ("toys", 2, 6), (None, 1, 1),
        ]
        assert rows(business.q4a_top_sellers(given), "seller_id", "orders") == [
            ("s1", 3), ("s2", 2), ("s0", 1),
        ]
        assert rows(business.q4b_top_categories(given)) == [("food", 2), ("toys", 2), (None, 1)]


def test_hot_orders_change_no_result(spark, tmp_path, raw, monkeypatch):  # noqa: F811
    with open(raw["stg_order_items"], "a") as file:
        file.writelines(f"o1\t{i}\tp1\ts1\t\t{i}.00\t1.00\n" for i in range(2, 400))
    with open(raw["stg_order_payments"], "a") as file:
        file.writelines(f"o2\t{i}\tboleto\t1\t{i}.00\n" for i in range(2, 300))
    tables = ["sales_lines", "fact_orders", "fact_order_items", "fact_payments", "placed_orders"]

    def loaded(folder):
        with Warehouse.from_files(spark, raw, str(tmp_path / folder)) as w:
            ledger = w.loss_ledger()
            return rows(w["hot_orders"]), [sorted(map(str, w[t].collect())) for t in tables], sorted(
                map(str, ledger.collect())
            )

    none, *plain = loaded("plain")
    monkeypatch.setattr(dealing.hot_orders, "__defaults__", (100,))
    hot, *salted = loaded("salted")
    assert none == [] and {o for o, _ in hot} == {"o1", "o2"}
    assert salted == plain


def test_null_orders_are_not_hot(spark):
    lines = staging(spark, "stg_order_items", *[{"order_id": None}] * 50, {"order_id": "o1"})
    assert rows(hot_orders([lines], 4, least_rows=1)) == [("o1", 4)]
    assert hot_orders([lines.where("order_id IS NULL")], 4, least_rows=1).count() == 0


@pytest.mark.parametrize("buckets", [None, Buckets(2)])
def test_stored_files_can_be_read_in_parts(spark, tmp_path, monkeypatch, buckets):
    """A file is several row groups, each of them a task's share."""
    monkeypatch.setattr(store, "ROW_GROUP_BYTES", 1 << 20)
    df = spark.range(0, 400_000, 1, 1).selectExpr("uuid() AS order_id", "0 AS order_salt")
    written = TableStore(spark, str(tmp_path)).replace("t", df.repartition(2, *DEALT), buckets=buckets)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        scanned = written.groupBy(F.spark_partition_id()).count() if not buckets else None
        sizes = [r["count"] for r in scanned.collect()] if scanned else []
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    files = list((tmp_path / "t").glob("*.parquet"))
    assert len(files) == 2
    assert all(ParquetFile(file).num_row_groups > 2 for file in files)
    assert written.count() == 400_000 and all(n < 100_000 for n in sizes)


def test_tables_are_written_side_by_side(spark, tmp_path):
    """Each build waits until the other has begun."""
    both = Barrier(2, timeout=60)

    class Source(dict):
        def __getitem__(self, name):
            both.wait()
            return super().__getitem__(name)

    source = Source(a=spark.range(3), b=spark.range(4))
    tables = store.StoredTables(TableStore(spark, str(tmp_path)), source)
    assert [df.count() for df in store.at_once(tables, ["a", "b"])] == [3, 4]
    assert [tables[name].count() for name in "ab"] == [3, 4]  # read, not built again


def test_a_table_is_built_by_one_thread(spark, tmp_path):
    built = []

    class Source(dict):
        def __getitem__(self, name):
            built.append(name)
            return super().__getitem__(name)

    tables = store.StoredTables(TableStore(spark, str(tmp_path)), Source(a=spark.range(3)))
    assert [df.count() for df in store.at_once(tables, ["a", "a", "a"])] == [3, 3, 3]
    assert built == ["a"]
