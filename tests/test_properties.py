"""What must hold on any input."""

from decimal import Decimal

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from stallkeeper.plans.catalog import REPORTS
from stallkeeper.plans.warehouse import Warehouse
from stallkeeper.plans.warehouse import testdata_warehouse as warehouse_of
from stallkeeper.sources.schemas import STAR
from stallkeeper.sources.store import TableStore


@pytest.fixture(scope="module")
def w(spark):
    return warehouse_of(spark, f"{TESTDATA}/sf0.01")


def report(w, name):
    return REPORTS[name](w).collect()


@pytest.mark.parametrize(
    ("name", "share"),
    [
        ("q3_category_share", "pct_of_revenue"),
        ("q5a_status_mix", "pct_of_orders"),
        ("q7_payment_mix", "pct_of_payments"),
        ("q8_loyalty", "pct_of_customers"),
        ("q8_loyalty", "pct_of_revenue"),
    ],
)
def test_shares_add_up(w, name, share):
    shares = [row[share] for row in report(w, name)]
    assert abs(sum(shares) - 100) <= Decimal("0.005") * len(shares)


def test_reports_agree_on_totals(w):
    kpis = report(w, "q1_kpis")[0]
    revenue = kpis.product_revenue_brl
    months = report(w, "q2_monthly_revenue")
    assert sum(r.orders for r in months) == kpis.delivered_orders
    assert sum(r.revenue_brl for r in months) == revenue
    assert report(w, "a2_cumulative_revenue")[-1].cumulative_revenue_brl == revenue
    assert sum(r.revenue_brl for r in report(w, "q3_category_share")) == revenue
    assert sum(r.revenue_brl for r in report(w, "q6_revenue_by_state")) == revenue
    assert sum(r.revenue_brl for r in report(w, "q8_loyalty")) == revenue
    assert sum(r.segment_revenue_brl for r in report(w, "a4_rfm_segments")) == revenue
    assert sum(r.customers for r in report(w, "a4_rfm_segments")) == kpis.unique_customers
    assert sum(r.new_customers for r in report(w, "a6_cohorts")) == kpis.unique_customers


def test_pareto_ends_with_everything(w):
    last = report(w, "a5_pareto")[-1]
    sellers = w["seller_positions"].count()
    assert tuple(last) == (Decimal("100.0"), sellers, Decimal("100.0"))


def test_buckets_are_even(w):
    scores = REPORTS["a4_rfm_scores"](w)
    for score in ("r_score", "f_score", "m_score"):
        sizes = [r["count"] for r in scores.groupBy(score).count().collect()]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_clean_star_has_no_violations(w):
    for name, count in (
        ("check_primary_keys", "duplicate_keys"),
        ("check_foreign_keys", "orphans"),
        ("check_not_null", "nulls"),
    ):
        found = REPORTS[name](w)
        assert found.where((F.col("stage") == "clean") & (F.col(count) > 0)).count() == 0
    assert REPORTS["check_primary_keys"](w).where("stage = 'raw' and duplicate_keys > 0").count()
    assert REPORTS["check_foreign_keys"](w).where("stage = 'raw' and orphans > 0").count()


def test_result_does_not_depend_on_row_order(spark, w, tmp_path):
    shuffled = {
        name: df.repartition(3, F.hash(*df.columns)).sortWithinPartitions(F.hash(*df.columns))
        for name, df in w.staging.items()
    }
    again = Warehouse(shuffled, TableStore(spark, str(tmp_path)))
    for name in (*STAR, "sales_lines", "customer_totals"):
        assert again[name].exceptAll(w[name]).count() == 0
        assert again[name].count() == w[name].count()
    for name in ("a4_rfm_scores", "a5_seller_curve", "a3_top_seller_per_category"):
        assert REPORTS[name](again).exceptAll(REPORTS[name](w)).count() == 0
