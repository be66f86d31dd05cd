"""Fixed schemas and declared constraints. Nothing is inferred from files."""

from dataclasses import dataclass

from pyspark.sql.types import StringType, StructField, StructType


def _text(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


# Column names and order of the seven raw inputs, misspellings included.
STAGING = {
    "stg_customers": _text(
        "customer_id", "customer_unique_id", "customer_zip_code_prefix",
        "customer_city", "customer_state",
    ),
    "stg_orders": _text(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp",
        "order_approved_at", "order_delivered_carrier_date",
        "order_delivered_customer_date", "order_estimated_delivery_date",
    ),
    "stg_order_items": _text(
        "order_id", "order_item_id", "product_id", "seller_id",
        "shipping_limit_date", "price", "freight_value",
    ),
    "stg_order_payments": _text(
        "order_id", "payment_sequential", "payment_type",
        "payment_installments", "payment_value",
    ),
    "stg_products": _text(
        "product_id", "product_category_name", "product_name_lenght",
        "product_description_lenght", "product_photos_qty", "product_weight_g",
        "product_length_cm", "product_height_cm", "product_width_cm",
    ),
    "stg_sellers": _text(
        "seller_id", "seller_zip_code_prefix", "seller_city", "seller_state",
    ),
    "stg_category": _text("product_category_name", "product_category_name_english"),
}

STAR = (
    "dim_customers", "dim_products", "dim_sellers",
    "fact_orders", "fact_order_items", "fact_payments",
)


@dataclass(frozen=True)
class TableRules:
    """Constraints of one star table, with the raw columns they come from."""

    entity: str
    staging: str
    key: tuple[str, ...]
    raw_key: tuple[str, ...]
    not_null: tuple[str, ...]
    raw_not_null: tuple[str, ...]


@dataclass(frozen=True)
class ForeignKey:
    child: str
    parent: str
    column: str


RULES = {
    "dim_customers": TableRules(
        "customers", "stg_customers", ("customer_id",), ("customer_id",),
        ("customer_id",), ("customer_id",),
    ),
    "dim_products": TableRules(
        "products", "stg_products", ("product_id",), ("product_id",),
        ("product_id",), ("product_id",),
    ),
    "dim_sellers": TableRules(
        "sellers", "stg_sellers", ("seller_id",), ("seller_id",),
        ("seller_id",), ("seller_id",),
    ),
    "fact_orders": TableRules(
        "orders", "stg_orders", ("order_id",), ("order_id",),
        ("order_id", "customer_id"), ("order_id", "customer_id"),
    ),
    "fact_order_items": TableRules(
        "order_items", "stg_order_items",
        ("order_id", "item_seq"), ("order_id", "order_item_id"),
        ("order_id", "item_seq", "product_id", "seller_id", "price"),
        ("order_id", "order_item_id", "product_id", "seller_id", "price"),
    ),
    "fact_payments": TableRules(
        "payments", "stg_order_payments",
        ("order_id", "payment_seq"), ("order_id", "payment_sequential"),
        ("order_id", "payment_seq"), ("order_id", "payment_sequential"),
    ),
}

FOREIGN_KEYS = (
    ForeignKey("fact_orders", "dim_customers", "customer_id"),
    ForeignKey("fact_order_items", "fact_orders", "order_id"),
    ForeignKey("fact_order_items", "dim_products", "product_id"),
    ForeignKey("fact_order_items", "dim_sellers", "seller_id"),
    ForeignKey("fact_payments", "fact_orders", "order_id"),
)

# What the text columns that are converted are converted to.
CONVERSIONS = {
    "stg_customers": {"customer_zip_code_prefix": "int"},
    "stg_products": {"product_weight_g": "int"},
    "stg_orders": {
        "order_purchase_timestamp": "timestamp",
        "order_approved_at": "timestamp",
        "order_delivered_customer_date": "timestamp",
        "order_estimated_delivery_date": "timestamp",
    },
    "stg_order_items": {"order_item_id": "int", "price": "money", "freight_value": "money"},
    "stg_order_payments": {
        "payment_sequential": "int", "payment_installments": "int", "payment_value": "money",
    },
}

# Declared lengths of text columns, in characters, by how many they are.
_LENGTHS = {
    "stg_customers": {50: "customer_id customer_unique_id", 20: "customer_zip_code_prefix",
                      100: "customer_city", 10: "customer_state"},
    "stg_orders": {50: "order_id customer_id",
                   30: "order_status order_purchase_timestamp order_approved_at "
                       "order_delivered_carrier_date order_delivered_customer_date "
                       "order_estimated_delivery_date"},
    "stg_order_items": {50: "order_id product_id seller_id", 10: "order_item_id",
                        30: "shipping_limit_date", 20: "price freight_value"},
    "stg_order_payments": {50: "order_id", 10: "payment_sequential payment_installments",
                           30: "payment_type", 20: "payment_value"},
    "stg_products": {50: "product_id", 100: "product_category_name",
                     10: "product_name_lenght product_description_lenght product_photos_qty "
                         "product_weight_g product_length_cm product_height_cm product_width_cm"},
    "stg_sellers": {50: "seller_id", 20: "seller_zip_code_prefix", 100: "seller_city",
                    10: "seller_state"},
    "stg_category": {100: "product_category_name product_category_name_english"},
    "dim_customers": {50: "customer_id customer_unique_id", 100: "city", 5: "state"},
    "dim_products": {50: "product_id", 100: "category"},
    "dim_sellers": {50: "seller_id", 100: "seller_city", 5: "seller_state"},
    "fact_orders": {50: "order_id customer_id", 30: "order_status"},
    "fact_order_items": {50: "order_id product_id seller_id"},
    "fact_payments": {50: "order_id", 30: "payment_type"},
}
LENGTHS = {
    table: {column: n for n, columns in by_length.items() for column in columns.split()}
    for table, by_length in _LENGTHS.items()
}
