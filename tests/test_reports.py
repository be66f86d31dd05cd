from decimal import Decimal

import pytest
from frames import orders, rows, sale, sales
from pyspark.sql import functions as F

from stallkeeper.operators.ranking import in_global_order, with_rank
from stallkeeper.plans import advanced, business, mart
from stallkeeper.sources.store import TableStore

D = Decimal


@pytest.fixture
def sold(spark):
    return sales(
        spark,
        sale("o1", price="10.00"),
        sale("o1", item_seq=2, price="20.00", category="home", seller_id="s2"),
        sale("o2", person="u2", price="30.00", ts="2017-03-01", customer_state="RJ"),
        sale("o3", price="40.00", ts="2017-03-31", freight_value=None),
        sale("o4", price="99.00", order_status="shipped"),
        sale("o5", person=None, price="5.00", ts=None),
    )


@pytest.fixture
def totals(sold):
    return mart.order_totals(sold)


@pytest.fixture
def customers(totals):
    return mart.customer_totals(totals)


def test_q1_counts_persons_not_customer_ids(customers):
    assert rows(business.q1_kpis(customers)) == [(4, 2, 5, D("105.00"), D("4.00"), D("26.25"))]


def test_q1_of_nothing(customers):
    assert rows(business.q1_kpis(customers.limit(0))) == [(0, 0, 0, None, None, None)]


def test_q2_keeps_orders_without_a_date(totals):
    assert rows(business.q2_monthly_revenue(totals)) == [
        (None, 1, D("5.00")), ("2017-01", 1, D("30.00")), ("2017-03", 2, D("70.00")),
    ]


def test_other_statuses_on_request(sold):
    shipped = mart.order_totals(sold, "shipped")
    assert rows(business.q2_monthly_revenue(shipped)) == [("2017-01", 1, D("99.00"))]


def test_q3_counts_an_order_once_per_category(sold):
    assert rows(business.q3_category_share(sold)) == [
        ("toys", 4, 4, D("85.00"), D("80.95")), ("home", 1, 1, D("20.00"), D("19.05")),
    ]


def test_q4_top_lists_break_ties_by_key(spark):
    tied = sales(spark, *[
        sale(f"o{i}", price="7.00", seller_id=f"s{i:02}", category=f"c{i:02}") for i in range(15)
    ])
    expected = [f"{i:02}" for i in range(10)]
    assert [r.seller_id for r in business.q4a_top_sellers(tied).collect()] == [
        f"s{e}" for e in expected
    ]
    assert [r.category for r in business.q4b_top_categories(tied).collect()] == [
        f"c{e}" for e in expected
    ]
    assert business.q4a_top_sellers(tied, n=3).count() == 3


def test_q5(spark):
    df = orders(
        spark,
        ("1", "c", "delivered", None, None, None), ("2", "c", "canceled", None, None, None),
        ("3", "c", "delivered", None, None, None),
    )
    assert rows(business.q5a_status_mix(df)) == [
        ("delivered", 2, D("66.67")), ("canceled", 1, D("33.33")),
    ]
    assert rows(business.q5b_cancellation_rate(df)) == [(D("33.33"),)]


def test_q6_counts_a_person_once_per_state(totals):
    assert rows(business.q6_revenue_by_state(totals)) == [
        ("SP", 3, 1, D("75.00"), D("25.00")), ("RJ", 1, 1, D("30.00"), D("30.00")),
    ]


def test_q7(spark):
    payments = spark.createDataFrame(
        [("card", 3, D("10.00")), ("card", 4, D("5.50")), ("card", None, None), (None, 1, D("1"))],
        "payment_type string, installments int, payment_value decimal(12,2)",
    )
    assert rows(business.q7_payment_mix(payments)) == [
        ("card", 3, D("75.00"), D("3.50"), D("15.50")), (None, 1, D("25.00"), D("1.00"), D("1.00")),
    ]


def test_q8_counts_the_unknown_person_as_one(customers):
    assert rows(business.q8_loyalty(customers)) == [
        ("One-time", 2, D("66.67"), D("35.00"), D("33.33")),
        ("Repeat", 1, D("33.33"), D("70.00"), D("66.67")),
    ]


DELIVERIES = [
    ("1", "a", "delivered", "2017-01-01T23:59", "2017-01-03T00:01", "2017-01-02"),  # late, 2 days
    ("2", "b", "delivered", "2017-01-01", "2017-01-02", None),  # no promise: not late
    ("3", "a", "delivered", "2017-01-01", None, "2017-01-02"),  # no date: left out
    ("4", "a", "shipped", "2017-01-01", "2017-01-09", "2017-01-02"),
]


def test_q9(spark):
    assert rows(business.q9_delivery(orders(spark, *DELIVERIES))) == [(2, D("1.5"), D("50.00"))]


def test_a7_ignores_small_states(spark):
    customers = spark.createDataFrame([("a", "SP"), ("b", "RJ")], "customer_id string, state string")
    customers = customers.selectExpr("*", "'u' AS customer_unique_id", "'x' AS city")
    placed = mart.placed_orders(orders(spark, *DELIVERIES), customers)
    assert rows(advanced.a7_delivery_sla(placed)) == []
    assert rows(advanced.a7_delivery_sla(placed, min_orders=1)) == [
        ("SP", 1, D("2.0"), D("100.00")), ("RJ", 1, D("1.0"), D("0.00")),
    ]


def test_a1_compares_with_the_previous_month_present(spark):
    months = mart.order_totals(sales(
        spark,
        sale("o1", price="0.00", ts="2017-01-31"),
        sale("o2", price="20.00", ts="2017-02-01"),
        sale("o3", price="15.00", ts="2017-06-30"),
    ))
    assert rows(advanced.a1_mom_growth(months)) == [
        ("2017-01", D("0.00"), None, None),
        ("2017-02", D("20.00"), D("0.00"), None),  # no growth from nothing
        ("2017-06", D("15.00"), D("20.00"), D("-25.00")),
    ]


def test_a2_ends_at_the_total(totals):
    assert rows(advanced.a2_cumulative_revenue(totals)) == [
        (None, D("5.00"), D("5.00")),
        ("2017-01", D("30.00"), D("35.00")),
        ("2017-03", D("70.00"), D("105.00")),
    ]


def test_a3_one_seller_per_category(spark):
    df = sales(
        spark,
        sale("o1", seller_id="b", price="5.00"), sale("o2", seller_id="b", price="5.00"),
        sale("o3", seller_id="a", price="10.00"), sale("o4", category="x", price="1.00"),
    )
    assert rows(advanced.a3_top_seller_per_category(df)) == [
        ("toys", "a", D("10.00")), ("x", "s1", D("1.00")),
    ]


def ranked_sellers(spark, folder, revenues):
    sellers = spark.createDataFrame(
        [(f"s{i:04}", D(r)) for i, r in enumerate(revenues)],
        "seller_id string, revenue decimal(18,2)",
    )
    order = [F.desc("revenue"), F.asc("seller_id")]
    positions = TableStore(spark, str(folder)).table("p", lambda: in_global_order(sellers, order))
    return with_rank(positions, "revenue")


def test_a5_cuts_on_the_same_seller_are_one_row(spark, tmp_path):
    ranked = ranked_sellers(spark, tmp_path, ["1.00"] * 10)
    assert rows(advanced.a5_pareto(ranked)) == [
        (D("10.0"), 1, D("10.0")), (D("20.0"), 2, D("20.0")), (D("100.0"), 10, D("100.0")),
    ]


def test_a5_exact_shares_are_not_rounded_up(spark, tmp_path):
    ranked = ranked_sellers(spark, tmp_path, [str(i) for i in range(700)])
    assert [r.sellers for r in advanced.a5_pareto(ranked).collect()] == [7, 35, 70, 140, 700]


def test_a5_curve(spark, tmp_path):
    curve = advanced.a5_seller_curve(ranked_sellers(spark, tmp_path, ["1.00", "5.00", "5.00"]))
    assert sorted(rows(curve, "rn", "seller_id", "running_rev", "total_rev", "total_sellers")) == [
        (1, "s0001", D("5.00"), D("11.00"), 3),
        (2, "s0002", D("10.00"), D("11.00"), 3),
        (3, "s0000", D("11.00"), D("11.00"), 3),
    ]


def test_a5_of_nobody(spark, tmp_path):
    assert rows(advanced.a5_pareto(ranked_sellers(spark, tmp_path, []))) == []


def test_a6_counts_any_second_order_and_no_unknown_person(spark):
    customers = mart.customer_totals(mart.order_totals(sales(
        spark,
        sale("o1", ts="2017-01-05"), sale("o2", ts="2017-01-05"),  # same day counts
        sale("o3", person="u2", ts="2017-01-09"), sale("o4", person="u3", ts="2017-02-01"),
        sale("o5", person=None), sale("o6", person=None),
    )))
    assert rows(advanced.a6_cohorts(customers)) == [
        ("2017-01", 2, 1, D("50.00")), ("2017-02", 1, 0, D("0.00")),
    ]
