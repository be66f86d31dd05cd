"""Raw text staging tables to the typed star schema.

The `traced_*` functions keep what they drop, with the rule that dropped it; the others are the rows
that stay. `RULES_OF` has the rules of each table in the order in which they are applied.
"""

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions.casts import blank, folded, to_int, to_money, to_timestamp
from stallkeeper.functions.measures import days_between
from stallkeeper.operators.buckets import shared_keys
from stallkeeper.operators.dedup import (
    COPIES, DUPLICATE, LOST_BY, first_rule, in_order, keep_first, keep_first_traced, kept,
)

ORDER_COLUMNS = (
    "order_id", "customer_id", "order_status", "purchase_ts", "approved_ts", "delivered_ts",
    "estimated_ts", "delivery_days",
)
PAYMENT_COLUMNS = (
    "order_id", "payment_seq", "payment_type", "installments", "payment_value",
)
ITEM_COLUMNS = (
    "order_id", "item_seq", "product_id", "seller_id", "price", "freight_value", "item_total",
)
_TRACE = (LOST_BY, COPIES)

NULL_KEY, BAD_KEY = "key is null", "key does not convert"
BAD_PRICE, NEGATIVE_PRICE = "price does not convert", "price is negative"
NO_CUSTOMER, NO_ORDER = "customer is missing", "order is missing"
NO_PRODUCT, NO_SELLER = "product is missing", "seller is missing"
RULES_OF = {
    "dim_customers": (NULL_KEY, DUPLICATE),
    "dim_products": (NULL_KEY, DUPLICATE),
    "dim_sellers": (NULL_KEY, DUPLICATE),
    "fact_orders": (NULL_KEY, DUPLICATE, NO_CUSTOMER),
    "fact_order_items": (
        NULL_KEY, BAD_KEY, BAD_PRICE, NEGATIVE_PRICE, DUPLICATE, NO_ORDER, NO_PRODUCT, NO_SELLER,
    ),
    "fact_payments": (NULL_KEY, BAD_KEY, DUPLICATE, NO_ORDER),
}


def traced_customers(stg: DataFrame) -> DataFrame:
    """One row per customer_id, which is issued per order; customer_unique_id is the person."""
    first = keep_first_traced(
        stg,
        ["customer_id"],
        ["customer_unique_id", "customer_city", "customer_state", "customer_zip_code_prefix"],
        first_rule((NULL_KEY, F.col("customer_id").isNull())),
    )
    return first.select(
        "customer_id",
        "customer_unique_id",
        to_int(F.col("customer_zip_code_prefix")).alias("zip_prefix"),
        F.lower(F.trim("customer_city")).alias("city"),
        F.upper(F.trim("customer_state")).alias("state"),
        *_TRACE,
    )


def dim_customers(stg: DataFrame) -> DataFrame:
    return kept(traced_customers(stg))


def traced_sellers(stg: DataFrame) -> DataFrame:
    cleaned = stg.select(
        "seller_id",
        F.lower(F.trim("seller_city")).alias("seller_city"),
        F.upper(F.trim("seller_state")).alias("seller_state"),
    )
    return keep_first_traced(
        cleaned,
        ["seller_id"],
        ["seller_city", "seller_state"],
        first_rule((NULL_KEY, F.col("seller_id").isNull())),
    )


def dim_sellers(stg: DataFrame) -> DataFrame:
    return kept(traced_sellers(stg))


def traced_products(
    stg: DataFrame, stg_category: DataFrame, default: str = "unknown"
) -> DataFrame:
    """Category is the translation, else the original name, else the default."""
    translations = stg_category.select(
        folded(F.col("product_category_name")).alias("_name"),
        F.col("product_category_name_english").alias("_english"),
    )
    # One translation per name first: joining repeated names would multiply products.
    translations = keep_first(
        translations.where(F.col("_name").isNotNull()), ["_name"], in_order("_english")
    )
    first = keep_first_traced(
        stg.select("product_id", "product_category_name", "product_weight_g"),
        ["product_id"],
        ["product_category_name", "product_weight_g"],
        first_rule((NULL_KEY, F.col("product_id").isNull())),
    )
    name = F.col("product_category_name")
    return first.join(translations, folded(name) == F.col("_name"), "left").select(
        "product_id",
        F.coalesce("_english", F.when(~blank(name), F.trim(name)), F.lit(default)).alias(
            "category"
        ),
        to_int(F.col("product_weight_g")).alias("weight_g"),
        *_TRACE,
    )


def dim_products(stg: DataFrame, stg_category: DataFrame, default: str = "unknown") -> DataFrame:
    return kept(traced_products(stg, stg_category, default))


def traced_headers(stg: DataFrame) -> DataFrame:
    """Typed orders, one per order_id, customer not yet checked."""
    typed = stg.select(
        "order_id",
        "customer_id",
        F.lower(F.trim("order_status")).alias("order_status"),
        to_timestamp(F.col("order_purchase_timestamp")).alias("purchase_ts"),
        to_timestamp(F.col("order_approved_at")).alias("approved_ts"),
        to_timestamp(F.col("order_delivered_customer_date")).alias("delivered_ts"),
        to_timestamp(F.col("order_estimated_delivery_date")).alias("estimated_ts"),
    )
    first = keep_first_traced(
        typed,
        ["order_id"],
        [
            "customer_id", "order_status", "purchase_ts", "approved_ts", "delivered_ts",
            "estimated_ts",
        ],
        first_rule((NULL_KEY, F.col("order_id").isNull())),
    )
    return first.withColumn(
        "delivery_days", days_between(F.col("purchase_ts"), F.col("delivered_ts"))
    )


def order_headers(stg: DataFrame) -> DataFrame:
    return kept(traced_headers(stg))


def fact_orders(stg: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders whose customer exists."""
    return (
        order_headers(stg).join(customers, "customer_id", "left_semi").select(*ORDER_COLUMNS)
    )


def traced_lines(stg: DataFrame, min_price: int = 0) -> DataFrame:
    """Typed lines, one per (order_id, item_seq), parents not yet checked.

    Unusable prices go before de-duplication: a bad copy must not win over a good
    one. The key is the converted sequence, so '1' and '01' are the same line.
    """
    typed = stg.select(
        "order_id",
        to_int(F.col("order_item_id")).alias("item_seq"),
        "product_id",
        "seller_id",
        to_money(F.col("price")).alias("price"),
        to_money(F.col("freight_value")).alias("freight_value"),
    )
    first = keep_first_traced(
        typed,
        ["order_id", "item_seq"],
        ["product_id", "seller_id", "price", "freight_value"],
        first_rule(
            (NULL_KEY, F.col("order_id").isNull()),
            (BAD_KEY, F.col("item_seq").isNull()),
            (BAD_PRICE, F.col("price").isNull()),
            (NEGATIVE_PRICE, F.col("price") < min_price),
        ),
    )
    freight = F.coalesce("freight_value", F.lit(Decimal("0.00")))
    return first.withColumn("item_total", (F.col("price") + freight).cast("decimal(14,2)"))


def order_lines(stg: DataFrame, min_price: int = 0) -> DataFrame:
    return kept(traced_lines(stg, min_price))


def fact_order_items(
    stg: DataFrame, orders: DataFrame, products: DataFrame, sellers: DataFrame, min_price: int = 0
) -> DataFrame:
    """Lines whose order, product and seller exist; checked after de-duplication."""
    return (
        order_lines(stg, min_price)
        .join(products, "product_id", "left_semi")
        .join(sellers, "seller_id", "left_semi")
        .join(orders, "order_id", "left_semi")
        .select(*ITEM_COLUMNS)
    )


def single_payments(stg: DataFrame) -> DataFrame:
    """Typed payments, one per (order_id, payment_seq), order not yet checked."""
    typed = stg.select(
        "order_id",
        to_int(F.col("payment_sequential")).alias("payment_seq"),
        F.lower(F.trim("payment_type")).alias("payment_type"),
        to_int(F.col("payment_installments")).alias("installments"),
        to_money(F.col("payment_value")).alias("payment_value"),
    )
    return keep_first_traced(
        typed,
        ["order_id", "payment_seq"],
        ["payment_type", "installments", "payment_value"],
        first_rule(
            (NULL_KEY, F.col("order_id").isNull()), (BAD_KEY, F.col("payment_seq").isNull())
        ),
    )


def traced_payments(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Payments of `single_payments`, those without an order marked."""
    keys = shared_keys(payments, orders)
    parents = orders.select(*keys, F.lit(True).alias("_order"))
    return with_parents(payments.join(parents, keys, "left"), (NO_ORDER, "_order")).select(
        *keys, "payment_seq", "payment_type", "installments", "payment_value", *_TRACE
    )


def fact_payments(stg: DataFrame, orders: DataFrame) -> DataFrame:
    return kept(traced_payments(single_payments(stg), orders))


def with_parents(joined: DataFrame, *parents: tuple[str, str]) -> DataFrame:
    """Rows that a left join found no parent for, marked so unless an earlier rule dropped them.
    Each parent is the name of its rule and the column that is NULL where it is missing."""
    missing = first_rule(*[(rule, F.col(found).isNull()) for rule, found in parents])
    return joined.withColumn(LOST_BY, F.coalesce(F.col(LOST_BY), missing))
