"""Business questions Q1-Q9.

Ties in an ordering are broken by the group's own key, so results are repeatable.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions.measures import (
    MONEY, PERCENT, count_where, days_between, month_label, percent, ratio,
)
from stallkeeper.operators.buckets import totals_per_order_group


def _total(grouped: DataFrame, *columns: str) -> Column:
    """Sums over all groups, as fields of one subquery: however many groups there are, none has to
    be in one task with all others.

    All measures have to be named, used or not: then the subquery groups its input exactly as the
    query does, and Spark runs that once for both.
    """
    return grouped.agg(F.struct(*[F.sum(c).alias(c) for c in columns])).scalar()


def _delivered(sales: DataFrame, status: str) -> DataFrame:
    return sales.where(F.col("order_status") == status)


def q1_kpis(customers: DataFrame) -> DataFrame:
    """From customer totals: every order and person is in exactly one row."""
    return customers.agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("delivered_orders"),
        F.count("customer_unique_id").alias("unique_customers"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items_sold"),
        F.sum("revenue").cast(MONEY).alias("product_revenue_brl"),
        F.sum("freight").cast(MONEY).alias("freight_brl"),
        ratio(F.sum("revenue"), F.sum("orders")).alias("avg_order_value_brl"),
    )


def q2_monthly_revenue(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy(month_label(F.col("purchase_ts")).alias("order_month"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("revenue").cast(MONEY).alias("revenue_brl"),
        )
        .orderBy("order_month")
    )


def q3_category_share(sales: DataFrame, status: str = "delivered") -> DataFrame:
    per_category = totals_per_order_group(
        _delivered(sales, status), ["category"], revenue_brl=F.col("price")
    ).withColumn("revenue_brl", F.col("revenue_brl").cast(MONEY))
    total = _total(per_category, "orders", "lines", "revenue_brl")["revenue_brl"]
    return per_category.select(
        "category",
        "orders",
        F.col("lines").alias("items_sold"),
        "revenue_brl",
        percent(F.col("revenue_brl"), total).alias("pct_of_revenue"),
    ).orderBy(F.desc("revenue_brl"), "category")


def q4a_top_sellers(sales: DataFrame, status: str = "delivered", n: int = 10) -> DataFrame:
    per_seller = totals_per_order_group(
        _delivered(sales, status), ["seller_id", "seller_state"], revenue_brl=F.col("price")
    )
    return (
        per_seller.select(
            "seller_id", "seller_state", "orders", F.col("revenue_brl").cast(MONEY).alias("revenue_brl")
        )
        .orderBy(F.desc("revenue_brl"), "seller_id")
        .limit(n)
    )


def q4b_top_categories(sales: DataFrame, status: str = "delivered", n: int = 10) -> DataFrame:
    return (
        totals_per_order_group(_delivered(sales, status), ["category"])
        .select("category", "orders")
        .orderBy(F.desc("orders"), "category")
        .limit(n)
    )


def q5a_status_mix(fact_orders: DataFrame) -> DataFrame:
    counted = fact_orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"))
    total = _total(counted, "orders")["orders"]
    return counted.withColumn("pct_of_orders", percent(F.col("orders"), total)).orderBy(
        F.desc("orders"), "order_status"
    )


def q5b_cancellation_rate(fact_orders: DataFrame) -> DataFrame:
    canceled = count_where(F.col("order_status") == "canceled")
    return fact_orders.agg(percent(canceled, F.count(F.lit(1))).alias("cancellation_rate_pct"))


def q6_revenue_by_state(orders: DataFrame) -> DataFrame:
    """Persons first, then states: exact distinct persons without repeating the rows."""
    persons = orders.groupBy("customer_state", "customer_unique_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue")
    )
    return (
        persons.groupBy("customer_state")
        .agg(
            F.sum("orders").alias("orders"),
            F.count("customer_unique_id").alias("customers"),
            F.sum("revenue").cast(MONEY).alias("revenue_brl"),
            ratio(F.sum("revenue"), F.sum("orders")).alias("avg_order_value_brl"),
        )
        .orderBy(F.desc("revenue_brl"), "customer_state")
    )


def q7_payment_mix(fact_payments: DataFrame) -> DataFrame:
    counted = fact_payments.groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("payment_rows"),
        F.avg(F.col("installments").cast("decimal(12,2)"))
        .cast("decimal(6,2)")
        .alias("avg_installments"),
        F.sum("payment_value").cast(MONEY).alias("total_paid_brl"),
    )
    total = _total(counted, "payment_rows", "avg_installments", "total_paid_brl")["payment_rows"]
    return counted.select(
        "payment_type",
        "payment_rows",
        percent(F.col("payment_rows"), total).alias("pct_of_payments"),
        "avg_installments",
        "total_paid_brl",
    ).orderBy(F.desc("payment_rows"), "payment_type")


def q8_loyalty(customers: DataFrame) -> DataFrame:
    kind = F.when(F.col("orders") == 1, "One-time").otherwise("Repeat")
    grouped = customers.groupBy(kind.alias("customer_type")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("revenue").cast(MONEY).alias("revenue_brl")
    )
    total = _total(grouped, "customers", "revenue_brl")
    return grouped.select(
        "customer_type",
        "customers",
        percent(F.col("customers"), total["customers"]).alias("pct_of_customers"),
        "revenue_brl",
        percent(F.col("revenue_brl"), total["revenue_brl"]).alias("pct_of_revenue"),
    ).orderBy("customer_type")


def delivery_measures(late_name: str) -> list:
    """Count, average days and share late, over delivered orders that have a date."""
    days = days_between(F.col("purchase_ts"), F.col("delivered_ts"))
    late = count_where(F.col("delivered_ts") > F.col("estimated_ts"))
    return [
        F.count(F.lit(1)).alias("delivered_orders"),
        F.avg(days.cast("decimal(8,2)")).cast("decimal(6,1)").alias("avg_delivery_days"),
        percent(late, F.count(F.lit(1)), PERCENT).alias(late_name),
    ]


def arrived(fact_orders: DataFrame, status: str = "delivered") -> DataFrame:
    return fact_orders.where(
        (F.col("order_status") == status) & F.col("delivered_ts").isNotNull()
    )


def q9_delivery(fact_orders: DataFrame, status: str = "delivered") -> DataFrame:
    return arrived(fact_orders, status).agg(*delivery_measures("pct_delivered_late"))
