"""Binds the TPC-H-like test tables to the seven raw staging inputs.

Every rule depends on keys only, and each cleaning rule gets rows to work on.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.sources.schemas import STAGING

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def base_paths(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{name}.parquet" for name in BASE_TABLES]


def bind(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in BASE_TABLES}
    return {
        "stg_customers": _customers(t["orders"], t["customer"], t["nation"]),
        "stg_orders": _orders(t["orders"]),
        "stg_order_items": _order_items(t["lineitem"]),
        "stg_order_payments": _payments(t["orders"]),
        "stg_products": _products(t["part"]),
        "stg_sellers": _sellers(t["supplier"], t["nation"], t["region"]),
        "stg_category": _categories(t["part"]),
    }


def _text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(12,2)").cast("string")


def _every(key: str, n: int, remainder: int = 0) -> Column:
    return F.col(key) % n == remainder


def _days_later(ts: str, days: Column) -> Column:
    return _text(F.col(ts) + F.make_dt_interval(days))


def _staging(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    """Columns without a rule are NULL."""
    missing = F.lit(None).cast("string")
    return df.select(*[columns.get(c, missing).alias(c) for c in STAGING[name].names])


def _customers(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    ids = {
        "customer_id": F.concat(F.lit("c"), _text("o_orderkey")),
        "customer_unique_id": F.concat(F.lit("u"), _text("o_custkey")),
    }
    located = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    zip_prefix = F.when(
        ~_every("o_orderkey", 41), _text(F.lit(1000) + F.col("c_nationkey"))
    )
    originals = _staging(
        located,
        "stg_customers",
        **ids,
        customer_zip_code_prefix=zip_prefix,
        customer_city=F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")),
        customer_state=F.concat(F.lower("n_name"), F.lit(" ")),
    )
    copies = _staging(
        orders.where(_every("o_orderkey", 53)),
        "stg_customers",
        **ids,
        customer_city=F.lit("~dup"),
        customer_state=F.lit("zz"),
    )
    return originals.unionByName(copies)


def _orders(orders: DataFrame) -> DataFrame:
    arrived = (F.col("o_orderstatus") == "F") & ~_every("o_orderkey", 97)
    next_day = F.substring(_days_later("o_orderdate", F.lit(1)), 1, 10)
    return _staging(
        orders,
        "stg_orders",
        order_id=_text("o_orderkey"),
        customer_id=F.when(_every("o_orderkey", 211), F.lit("c-missing")).otherwise(
            F.concat(F.lit("c"), _text("o_orderkey"))
        ),
        order_status=F.when(F.col("o_orderstatus") == "F", "Delivered ")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .when(F.col("o_orderstatus") == "P", "CANCELED"),
        order_purchase_timestamp=_text("o_orderdate"),
        order_approved_at=F.when(_every("o_orderkey", 97, 1), "not a date")
        .when(_every("o_orderkey", 89, 3), F.concat(F.lit(" "), next_day, F.lit("T10:56:33 ")))
        .when(_every("o_orderkey", 83, 5), F.concat(next_day, F.lit(" 10:56")))
        .otherwise(_days_later("o_orderdate", F.lit(1))),
        order_delivered_customer_date=F.when(
            arrived,
            _days_later("o_orderdate", (F.col("o_orderkey") % 23 + 2).cast("int")),
        ).otherwise(""),
        order_estimated_delivery_date=_days_later("o_orderdate", F.lit(20)),
    )


def _order_items(lineitem: DataFrame) -> DataFrame:
    line = lineitem.withColumn("k", F.col("l_orderkey") + F.col("l_linenumber"))
    return _staging(
        line,
        "stg_order_items",
        order_id=_text("l_orderkey"),
        order_item_id=F.when(
            _every("l_orderkey", 67), F.concat(F.lit("0"), _text("l_linenumber"))
        ).otherwise(_text("l_linenumber")),
        product_id=F.when(_every("k", 101), "p-missing").otherwise(_text("l_partkey")),
        seller_id=_text("l_suppkey"),
        price=F.when(_every("k", 89), "n/a")
        .when(_every("k", 79), "1e3")
        .when(_every("k", 83), "-1.00")
        .otherwise(_money("l_extendedprice")),
        freight_value=_money("l_quantity"),
    )


def _payments(orders: DataFrame) -> DataFrame:
    first = F.struct(
        F.when(_every("o_orderkey", 61), "x").otherwise("1").alias("seq"),
        F.concat(F.lit(" "), F.upper("o_orderpriority")).alias("type"),
        _text(F.col("o_orderkey") % 10 + 1).alias("installments"),
        _money("o_totalprice").alias("value"),
    )
    second = F.struct(
        F.lit("2").alias("seq"),
        F.lit("VOUCHER").alias("type"),
        F.lit("1").alias("installments"),
        F.lit("10.00").alias("value"),
    )
    # One pass over the orders: each yields one, two or three payment rows.
    rows = (
        F.when(_every("o_orderkey", 49), F.array(first, second, second))
        .when(_every("o_orderkey", 7), F.array(first, second))
        .otherwise(F.array(first))
    )
    return _staging(
        orders.select("o_orderkey", F.inline(rows)),
        "stg_order_payments",
        order_id=_text("o_orderkey"),
        payment_sequential=F.col("seq"),
        payment_type=F.col("type"),
        payment_installments=F.col("installments"),
        payment_value=F.col("value"),
    )


def _products(part: DataFrame) -> DataFrame:
    originals = _staging(
        part,
        "stg_products",
        product_id=_text("p_partkey"),
        product_category_name=F.when(_every("p_partkey", 50), " ").otherwise(F.col("p_brand")),
        product_weight_g=_text("p_size"),
    )
    copies = _staging(
        part.where(_every("p_partkey", 59)),
        "stg_products",
        product_id=_text("p_partkey"),
        product_category_name=F.lit("~dup"),
        product_weight_g=F.lit("x"),
    )
    return originals.unionByName(copies)


def _sellers(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    located = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    originals = _staging(
        located,
        "stg_sellers",
        seller_id=_text("s_suppkey"),
        seller_city=F.col("r_name"),
        seller_state=F.col("n_name"),
    )
    copies = _staging(
        supplier.where(_every("s_suppkey", 9)),
        "stg_sellers",
        seller_id=_text("s_suppkey"),
        seller_city=F.lit("~dup"),
        seller_state=F.lit("zz"),
    )
    return originals.unionByName(copies)


def _categories(part: DataFrame) -> DataFrame:
    brands = (
        part.where(~F.col("p_brand").isin("Brand#24", "Brand#25")).select("p_brand").distinct()
    )
    return _staging(
        brands,
        "stg_category",
        product_category_name=F.col("p_brand"),
        product_category_name_english=F.replace(
            F.lower("p_brand"), F.lit("brand#"), F.lit("category_")
        ),
    )
