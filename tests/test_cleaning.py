from datetime import datetime
from decimal import Decimal

import pytest
from frames import rows, staging
from pyspark.sql import functions as F

from stallkeeper.operators import cleaning, quality
from stallkeeper.operators.dedup import in_order, keep_first
from stallkeeper.sources.schemas import LENGTHS, STAGING


def test_customers(spark):
    stg = staging(
        spark, "stg_customers",
        {"customer_id": "c1", "customer_unique_id": "u1", "customer_zip_code_prefix": "01409",
         "customer_city": "  Sao Paulo ", "customer_state": "sp "},
        {"customer_id": "c1", "customer_unique_id": "u1", "customer_city": "zzz"},
        {"customer_id": "c2", "customer_unique_id": "u1", "customer_zip_code_prefix": "x"},
        {"customer_id": None, "customer_unique_id": "u9"},
    )
    assert sorted(rows(cleaning.dim_customers(stg))) == [
        ("c1", "u1", 1409, "sao paulo", "SP"),
        ("c2", "u1", None, None, None),
    ]


def test_trim_removes_spaces_only(spark):
    stg = staging(spark, "stg_sellers", {"seller_id": "s1", "seller_city": " \tRio\t "})
    assert rows(cleaning.dim_sellers(stg)) == [("s1", "\trio\t", None)]


def test_sellers_keep_one_row_per_id(spark):
    stg = staging(
        spark, "stg_sellers",
        {"seller_id": "s1", "seller_city": "B", "seller_state": "x"},
        {"seller_id": "s1", "seller_city": "a", "seller_state": "y"},
        {"seller_id": None, "seller_city": "a"},
    )
    assert rows(cleaning.dim_sellers(stg)) == [("s1", "a", "Y")]


@pytest.fixture
def category(spark):
    return staging(
        spark, "stg_category",
        {"product_category_name": "Brinquedos ", "product_category_name_english": "toys"},
        {"product_category_name": "moveis", "product_category_name_english": "furniture"},
        {"product_category_name": "moveis", "product_category_name_english": "decor"},
        {"product_category_name": "vazio", "product_category_name_english": None},
    )


def test_products(spark, category):
    def product(product_id, name, weight=None):
        return {"product_id": product_id, "product_category_name": name, "product_weight_g": weight}

    stg = staging(
        spark, "stg_products",
        product("translated", "brinquedos", "100"),
        product("repeated translation", "moveis"),
        product("untranslated", " pcs  "),
        product("translated to nothing", "vazio"),
        product("blank", "  "),
        product("null", None, "12.5"),
        product("copies", "b", "2"),
        product("copies", "a", "x"),
        product(None, "a"),
    )
    assert sorted(rows(cleaning.dim_products(stg, category))) == [
        ("blank", "unknown", None),
        ("copies", "a", None),
        ("null", "unknown", None),
        ("repeated translation", "decor", None),
        ("translated", "toys", 100),
        ("translated to nothing", "vazio", None),
        ("untranslated", "pcs", None),
    ]


def test_products_default_is_a_parameter(spark, category):
    stg = staging(spark, "stg_products", {"product_id": "p"})
    assert rows(cleaning.dim_products(stg, category, default="other")) == [("p", "other", None)]


def order(order_id, customer="c1", status="Delivered ", purchase="2017-01-01 23:59:00",
          delivered="2017-01-03 00:01:00"):
    return {
        "order_id": order_id, "customer_id": customer, "order_status": status,
        "order_purchase_timestamp": purchase, "order_approved_at": "bad",
        "order_delivered_customer_date": delivered, "order_estimated_delivery_date": "2017-01-02",
    }


def test_orders(spark):
    customers = spark.createDataFrame([("c1",)], "customer_id string")
    stg = staging(
        spark, "stg_orders",
        order("o1"),
        order("o2", delivered=""),
        order("o3", purchase="", delivered=None),
        order("orphan", customer="nobody"),
        order("no customer", customer=None),
        order(None),
    )
    jan1, jan2, jan3 = (datetime(2017, 1, d) for d in (1, 2, 3))
    assert sorted(rows(cleaning.fact_orders(stg, customers))) == [
        ("o1", "c1", "delivered", jan1.replace(hour=23, minute=59), None, jan3.replace(minute=1),
         jan2, 2),
        ("o2", "c1", "delivered", jan1.replace(hour=23, minute=59), None, None, jan2, None),
        ("o3", "c1", "delivered", None, None, None, jan2, None),
    ]


def test_order_copies_are_resolved_before_the_customer_check(spark):
    customers = spark.createDataFrame([("c2",)], "customer_id string")
    stg = staging(spark, "stg_orders", order("o1", customer="c1"), order("o1", customer="c2"))
    # The first copy wins, and its customer does not exist.
    assert rows(cleaning.fact_orders(stg, customers)) == []


def item(order_id="o1", seq="1", product="p1", seller="s1", price="5.00", freight="1.50"):
    return {"order_id": order_id, "order_item_id": seq, "product_id": product,
            "seller_id": seller, "price": price, "freight_value": freight}


@pytest.fixture
def parents(spark):
    return (
        spark.createDataFrame([("o1",), ("o2",)], "order_id string"),
        spark.createDataFrame([("p1",), ("p2",)], "product_id string"),
        spark.createDataFrame([("s1",)], "seller_id string"),
    )


def test_items(spark, parents):
    stg = staging(
        spark, "stg_order_items",
        item(seq="1"),
        item(seq="01", product="p2"),
        item(seq="2", price="n/a"),
        item(seq="2", price="7", freight=None),
        item(seq="3", price="-1.00"),
        item(seq="4", price="1e3"),
        item(seq="5", price="0"),
        item(seq="x"),
        item(seq="6", product="nothing"),
        item(seq="7", seller="nobody"),
        item(order_id="o9"),
        item(order_id=None),
    )
    assert sorted(rows(cleaning.fact_order_items(stg, *parents))) == [
        ("o1", 1, "p1", "s1", Decimal("5.00"), Decimal("1.50"), Decimal("6.50")),
        ("o1", 2, "p1", "s1", Decimal("7.00"), None, Decimal("7.00")),
        ("o1", 5, "p1", "s1", Decimal("0.00"), Decimal("1.50"), Decimal("1.50")),
    ]


def test_item_copies_are_resolved_before_the_parent_checks(spark, parents):
    stg = staging(spark, "stg_order_items", item(product="nothing"), item(product="p1"))
    assert rows(cleaning.fact_order_items(stg, *parents)) == []


def test_bad_price_does_not_win_over_a_good_copy(spark, parents):
    stg = staging(
        spark, "stg_order_items", item(product="p1", price="bad"), item(product="p2", price="3")
    )
    assert rows(cleaning.fact_order_items(stg, *parents), "product_id") == [("p2",)]


def test_item_types(spark, parents):
    stg = staging(spark, "stg_order_items", item())
    assert cleaning.fact_order_items(stg, *parents).dtypes == [
        ("order_id", "string"), ("item_seq", "int"), ("product_id", "string"),
        ("seller_id", "string"), ("price", "decimal(12,2)"), ("freight_value", "decimal(12,2)"),
        ("item_total", "decimal(14,2)"),
    ]


def test_payments(spark, parents):
    def payment(order_id, seq, kind=" Credit_Card", installments="3", value="9.99"):
        return {"order_id": order_id, "payment_sequential": seq, "payment_type": kind,
                "payment_installments": installments, "payment_value": value}

    stg = staging(
        spark, "stg_order_payments",
        payment("o1", "1"),
        payment("o1", "01", kind="zzz"),
        payment("o1", "2", installments="", value="bad"),
        payment("o1", "x"),
        payment("o9", "1"),
        payment(None, "1"),
    )
    assert sorted(rows(cleaning.fact_payments(stg, parents[0]))) == [
        ("o1", 1, "credit_card", 3, Decimal("9.99")),
        ("o1", 2, "credit_card", None, None),
    ]


def test_hot_key_is_cut_to_one_row_per_task_before_the_shuffle(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    first = keep_first(df, ["k"], in_order("v"))
    plan = first._jdf.queryExecution().executedPlan().toString()
    partial = [line for line in plan.splitlines() if "WindowGroupLimit" in line and "Partial" in line]
    assert partial and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    # 0 stands for itself and for all multiples of 3.
    assert first.count() == 20001
    assert first.where("k = 0").first().v == 0


def test_lengths_are_those_of_characters(spark):
    def table(name):
        return staging(spark, name, {c: "x" * n for c, n in LENGTHS[name].items()})

    tables = {name: table(name) for name in STAGING}
    tables["stg_sellers"] = staging(
        spark, "stg_sellers", {"seller_id": "é" * 51, "seller_state": "\U0001f600" * 10}, {},
        {"seller_id": "s" * 60},
    )
    star = {
        name: spark.createDataFrame([tuple("y" * n for n in columns.values())], list(columns))
        for name, columns in LENGTHS.items() if name not in STAGING
    }
    found = quality.check_lengths(tables, star).collect()
    assert {(r.table_name, r.column_name): r.declared for r in found} == {
        (t, c): n for t, columns in LENGTHS.items() for c, n in columns.items()
    }
    assert all(c in STAGING[t].names for t, columns in LENGTHS.items() if t in STAGING for c in columns)
    changed = {(r.column_name, r.longest, r.too_long) for r in found if r.longest != r.declared}
    assert changed == {
        ("seller_id", 60, 2), ("seller_zip_code_prefix", None, 0), ("seller_city", None, 0),
    }
    assert sum(r.too_long for r in found) == 2
