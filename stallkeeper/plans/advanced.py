"""Advanced analyses A1-A7: growth, running totals, top-1, RFM, Pareto, cohorts, SLA."""

from collections.abc import Sequence
from datetime import date
from decimal import Decimal
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallkeeper.functions.measures import (
    MONEY, count_where, days_between, month_label, month_start, percent, ratio,
)
from stallkeeper.operators.selection import keys_at_ranks
from stallkeeper.plans.business import arrived, delivery_measures


def _monthly(orders: DataFrame) -> DataFrame:
    return orders.groupBy(month_start(F.col("purchase_ts")).alias("month")).agg(
        F.sum("revenue").cast(MONEY).alias("revenue_brl")
    )


def a1_mom_growth(orders: DataFrame) -> DataFrame:
    """Growth against the previous month that has sales; gaps are not filled."""
    by_month = Window.orderBy("month")  # one row per calendar month
    previous = F.lag("revenue_brl").over(by_month)
    growth = percent(F.col("revenue_brl") - F.col("prev_month_brl"), F.col("prev_month_brl"), MONEY)
    return (
        _monthly(orders)
        .withColumn("prev_month_brl", previous)
        .orderBy("month")
        .select(
            month_label(F.col("month")).alias("order_month"),
            "revenue_brl",
            "prev_month_brl",
            growth.alias("mom_growth_pct"),
        )
    )


def a2_cumulative_revenue(orders: DataFrame) -> DataFrame:
    so_far = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulative = F.sum("revenue_brl").over(so_far).cast(MONEY)
    return (
        _monthly(orders)
        .withColumn("cumulative_revenue_brl", cumulative)
        .orderBy("month")
        .select(
            month_label(F.col("month")).alias("order_month"),
            "revenue_brl",
            "cumulative_revenue_brl",
        )
    )


def a3_top_seller_per_category(sales: DataFrame, status: str = "delivered") -> DataFrame:
    revenue = (
        sales.where(F.col("order_status") == status)
        .groupBy("category", "seller_id")
        .agg(F.sum("price").cast(MONEY).alias("revenue_brl"))
    )
    best_first = Window.partitionBy("category").orderBy(F.desc("revenue_brl"), "seller_id")
    return (
        revenue.withColumn("rnk", F.row_number().over(best_first))
        .where(F.col("rnk") == 1)
        .drop("rnk")
        .orderBy(F.desc("revenue_brl"), "category")
    )


# RFM dimensions.
RECENCY, FREQUENCY, MONETARY = range(3)
_BORDER = "struct<value_missing: boolean, value: decimal(18,2), customer_unique_id: string>"


def rfm_borders(customers: DataFrame, buckets: int = 4) -> DataFrame:
    """One row with the keys at which the buckets of each dimension end, found by counting persons.

    Recency by days descending is last purchase day ascending, which does not
    depend on the as-of date. A missing purchase date ranks as most recent.
    """
    n = customers.count()
    ends = [n // buckets * b + min(n % buckets, b) for b in range(1, buckets)] if n else []
    cents = (F.col("revenue") * 100).cast("bigint")
    values = [_last_day().cast("bigint"), F.col("orders"), cents]
    found = keys_at_ranks(customers, values, "customer_unique_id", [ends] * 3)
    scales = {RECENCY: 0, FREQUENCY: 0, MONETARY: -2}
    borders = [
        None if not ends else (key is None, None if key is None else Decimal(key).scaleb(scales[d]), person)
        for d, keys in enumerate(found)
        for key, person in (keys or [(None, None)] * (buckets - 1))
    ]
    names = [f"d{d}b{b}" for d in range(3) for b in range(1, buckets)]
    schema = ", ".join(f"{name} {_BORDER}" for name in names)
    return customers.sparkSession.createDataFrame([tuple(borders)], schema)


def _last_day() -> Column:
    return F.unix_date(F.col("last_purchase_ts").cast("date"))


def _rfm_keys() -> Column:
    values = [_last_day(), F.col("orders"), F.col("revenue")]  # RECENCY, FREQUENCY, MONETARY
    return F.array(
        *[
            F.struct(v.isNull().alias("value_missing"), v.cast(MONEY).alias("value"))
            for v in values
        ]
    )


def a4_rfm_scores(
    customers: DataFrame,
    borders: DataFrame,
    fact_orders: DataFrame,
    buckets: int = 4,
    as_of: date | None = None,
) -> DataFrame:
    """Quartile scores per person.

    `borders` are the `rfm_borders` of the persons: a score is 1 + the number of keys at which a
    bucket ends that are below the person's own, so persons are scored where they are.
    """
    last_purchase = fact_orders.agg(F.max("purchase_ts").cast("date").alias("d")).scalar()
    borders = borders.select(F.struct("*").alias("borders")).scalar()

    def score(dimension: int) -> Column:
        value = F.col("keys")[dimension]
        own = F.struct(
            value["value_missing"].alias("value_missing"),
            value["value"].alias("value"),
            F.col("customer_unique_id"),
        )
        above = [
            (F.col("borders")[f"d{dimension}b{b}"] < own).cast("bigint")
            for b in range(1, buckets)
        ]
        return reduce(add, above, F.lit(1).cast("bigint"))

    reference_day = F.lit(as_of) if as_of else last_purchase
    return (
        customers.withColumn("keys", _rfm_keys())
        .withColumn("borders", borders)
        .select(
            "customer_unique_id",
            days_between(F.col("last_purchase_ts"), reference_day)
            .cast("bigint")
            .alias("recency_days"),
            F.col("orders").alias("frequency"),
            F.col("revenue").alias("monetary"),
            score(RECENCY).alias("r_score"),
            score(FREQUENCY).alias("f_score"),
            score(MONETARY).alias("m_score"),
        )
    )


def a4_rfm_segments(scores: DataFrame) -> DataFrame:
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    # Segment labels.
    segment = (
        F.when((r >= 3) & (f >= 3) & (m >= 3), "Champions")
        .when((m >= 3) & (r <= 2), "At risk (high value, gone quiet)")
        .when((r >= 3) & (f <= 2), "New / Promising")
        .when(f >= 3, "Loyal")
        .otherwise("Others")
    )
    return (
        scores.groupBy(segment.alias("segment"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            ratio(F.sum("monetary"), F.count("monetary")).alias("avg_spend_brl"),
            F.sum("monetary").cast(MONEY).alias("segment_revenue_brl"),
        )
        .orderBy(F.desc("segment_revenue_brl"), "segment")
    )


# Shares of sellers at which the Pareto curve is read.
PARETO_CUTS = (Decimal("0.01"), Decimal("0.05"), Decimal("0.10"), Decimal("0.20"), Decimal("1"))


def a5_seller_curve(ranked: DataFrame) -> DataFrame:
    """Every seller with rank and running revenue, biggest first."""
    return ranked.select(
        "seller_id",
        "revenue",
        F.col("running_revenue").cast(MONEY).alias("running_rev"),
        F.col("total_revenue").cast(MONEY).alias("total_rev"),
        "rn",
        F.col("n").alias("total_sellers"),
    )


def a5_pareto(ranked: DataFrame, cuts: Sequence[Decimal] = PARETO_CUTS) -> DataFrame:
    """Share of revenue held by the top sellers, at the given shares of sellers.

    The running sum is needed at the cuts only, so one aggregate computes it there.
    """

    def rank_at(cut: Decimal) -> Column:
        # A decimal share: a double can land just above a whole number and round up.
        return F.ceil(F.col("n") * F.lit(cut)).cast("bigint")

    held = [
        F.sum(F.when(F.col("rn") <= rank_at(cut), F.col("revenue"))).alias(f"top_{i}")
        for i, cut in enumerate(cuts)
    ]
    totals = ranked.agg(F.max("n").alias("n"), F.sum("revenue").alias("revenue"), *held)
    points = F.array(
        *[
            F.struct(rank_at(cut).alias("sellers"), F.col(f"top_{i}").alias("running_rev"))
            for i, cut in enumerate(cuts)
        ]
    )
    # Cuts that fall on the same seller are one row.
    return (
        totals.select("n", "revenue", F.inline(F.array_distinct(points)))
        .where(F.col("sellers") > 0)
        .select(
            percent(F.col("sellers"), F.col("n"), "decimal(5,1)").alias("top_pct_of_sellers"),
            "sellers",
            percent(F.col("running_rev"), F.col("revenue"), "decimal(5,1)").alias(
                "cumulative_pct_of_revenue"
            ),
        )
        .orderBy("top_pct_of_sellers", "sellers")
    )


def a6_cohorts(customers: DataFrame) -> DataFrame:
    """Persons by first month, and how many have more than one order (same month counts)."""
    return (
        customers.where(F.col("customer_unique_id").isNotNull())
        .groupBy("first_month")
        .agg(
            F.count(F.lit(1)).alias("new_customers"),
            count_where(F.col("orders") > 1).alias("returned_later"),
        )
        .orderBy("first_month")
        .select(
            month_label(F.col("first_month")).alias("cohort_month"),
            "new_customers",
            "returned_later",
            percent(F.col("returned_later"), F.col("new_customers")).alias("repeat_rate_pct"),
        )
    )


def a7_delivery_sla(placed: DataFrame, min_orders: int = 50) -> DataFrame:
    """Delivery per customer state, from orders with their customer."""
    return (
        arrived(placed)
        .groupBy("customer_state")
        .agg(*delivery_measures("pct_late"))
        .where(F.col("delivered_orders") >= min_orders)
        .orderBy(F.desc("avg_delivery_days"), "customer_state")
    )
