"""The reporting view and the rollups the reports share."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions.measures import MONEY, month_start
from stallkeeper.operators import cleaning
from stallkeeper.operators.buckets import shared_keys
from stallkeeper.operators.dedup import COPIES, LOST_BY, kept, traced

SALES_COLUMNS = (
    "order_id", "item_seq", "order_status", "purchase_ts", "delivered_ts", "estimated_ts",
    "delivery_days", "customer_id", "customer_unique_id", "customer_state", "customer_city",
    "product_id", "category", "seller_id", "seller_state", "price", "freight_value", "item_total",
)

PLACED_COLUMNS = (
    *cleaning.ORDER_COLUMNS, "customer_unique_id", "customer_state", "customer_city",
)


def traced_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with the person, city and state behind them; those without a customer are marked.

    customer_id is unique, so the join is also the referential check: `orders` may be the checked
    fact or the headers before the check.
    """
    found = customers.select(
        "customer_id",
        "customer_unique_id",
        F.col("state").alias("customer_state"),
        F.col("city").alias("customer_city"),
        F.lit(True).alias("_customer"),
    )
    joined = traced(orders).join(found, "customer_id", "left")
    return cleaning.with_parents(joined, (cleaning.NO_CUSTOMER, "_customer")).drop("_customer")


def placed_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return kept(traced_orders(orders, customers))


def traced_sales(
    lines: DataFrame,
    placed: DataFrame,
    products: DataFrame,
    sellers: DataFrame,
    deal: Callable[[DataFrame], DataFrame] = traced,
) -> DataFrame:
    """One row per sold line with order, customer, product and seller attributes, and the lines
    that have lost one of these.

    As in `traced_orders`, `lines` may come before or after the referential check. Orders come last:
    `deal` brings the lines to where the orders already are.
    """
    parents = [
        (products.select("product_id", "category"), "product_id", "_product"),
        (sellers.select("seller_id", "seller_state"), "seller_id", "_seller"),
    ]
    joined = traced(lines)
    for parent, key, found in parents:
        joined = joined.join(parent.withColumn(found, F.lit(True)), key, "left")
    joined, placed = deal(joined), kept(placed)
    keys = shared_keys(joined, placed)
    joined = joined.join(placed.withColumn("_order", F.lit(True)), keys, "left")
    checked = cleaning.with_parents(
        joined,
        (cleaning.NO_ORDER, "_order"),
        (cleaning.NO_PRODUCT, "_product"),
        (cleaning.NO_SELLER, "_seller"),
    )
    return checked.select(*SALES_COLUMNS, *keys[1:], LOST_BY, COPIES)


def sales_lines(
    lines: DataFrame, placed: DataFrame, products: DataFrame, sellers: DataFrame
) -> DataFrame:
    return kept(traced_sales(lines, placed, products, sellers))


def order_totals(sales: DataFrame, status: str = "delivered") -> DataFrame:
    """One row per order of the status. Its person, state and date are the same on every line."""
    return (
        sales.where(F.col("order_status") == status)
        .groupBy("order_id", "customer_unique_id", "customer_state", "purchase_ts")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.sum("price").cast(MONEY).alias("revenue"),
            F.sum("freight_value").cast(MONEY).alias("freight"),
        )
    )


def customer_totals(orders: DataFrame) -> DataFrame:
    """One row per person, from order totals."""
    return orders.groupBy("customer_unique_id").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("items").alias("items"),
        F.sum("revenue").cast(MONEY).alias("revenue"),
        F.sum("freight").cast(MONEY).alias("freight"),
        F.max("purchase_ts").alias("last_purchase_ts"),
        F.min(month_start(F.col("purchase_ts"))).alias("first_month"),
    )


def seller_totals(sales: DataFrame, status: str = "delivered") -> DataFrame:
    return (
        sales.where(F.col("order_status") == status)
        .groupBy("seller_id")
        .agg(F.sum("price").cast(MONEY).alias("revenue"))
    )
