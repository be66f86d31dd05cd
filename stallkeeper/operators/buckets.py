"""Tables on orders dealt alike, so that joins on the order need no exchange.

Orders, lines and payments are written in the same number of buckets by `order_id` and
`order_salt`. The salt is 0 for nearly all orders. An order with more rows than a few buckets should
hold is dealt over several salts from 1 on: its lines and payments by their own numbers, itself once
for each salt, so that every row still meets its order in its own bucket.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "order_salt"
DEALT_BY = ("order_id", SALT)
# An order is dealt over several salts if it has as many rows as this number of average buckets,
# and this number of rows.
HOT_BUCKETS, HOT_ROWS = 2, 1_000_000
# Orders that a sketch keeps count of for each one that could be hot; its error is well below a
# bucket then.
_TRACKED = 16
_MOST_TRACKED = 1_000_000


@dataclass(frozen=True)
class Buckets:
    """How a table is laid out in files: by a hash of `columns`, sorted by `sort` inside."""

    count: int
    columns: tuple[str, ...] = DEALT_BY
    sort: tuple[str, ...] = ()


def hot_orders(tables: list[DataFrame], buckets: int, least_rows: int = HOT_ROWS) -> DataFrame:
    """`order_id` and its number of `salts`, for orders with very many rows in one of the tables.

    Rows of each order are counted by a sketch of frequent items, one pass over one column; it
    decides only where rows go. At most `buckets` / HOT_BUCKETS orders of a table can be hot.
    """
    most = max(1, buckets // HOT_BUCKETS)
    tracked = min(_MOST_TRACKED, max(1000, _TRACKED * most))
    top = F.expr(f"approx_top_k(order_id, {min(most, tracked)}, {tracked})")
    salts: dict[str, int] = {}
    for table in tables:
        rows, found = table.where("order_id IS NOT NULL").agg(F.count(F.lit(1)), top).first()
        for order, count in found or []:
            if count >= max(least_rows, HOT_BUCKETS * rows / buckets):
                wanted = min(buckets, -(-count * buckets // rows))
                salts[order] = max(salts.get(order, 1), wanted)
    return tables[0].sparkSession.createDataFrame(
        sorted(salts.items()), "order_id string, salts int"
    )


def dealt(rows: DataFrame, by: str, hot: DataFrame, buckets: int) -> DataFrame:
    """Lines or payments with their salt, which follows from `by`, in as many partitions."""
    # Not more rows than buckets.
    salted = rows.join(F.broadcast(hot), "order_id", "left")
    # The salt of other orders is no constant, on which Spark would deal differently.
    number = F.xxhash64(by)
    salt = F.coalesce(F.pmod(number, F.col("salts")) + 1, F.pmod(number, F.lit(1))).cast("int")
    return salted.withColumn(SALT, salt).drop("salts").repartition(buckets, *DEALT_BY)


def dealt_orders(orders: DataFrame, hot: DataFrame, buckets: int) -> DataFrame:
    """Orders once for each of their salts."""
    salted = orders.join(F.broadcast(hot), "order_id", "left")
    salts = F.coalesce(F.sequence(F.lit(1), F.col("salts")), F.array(F.lit(0)))
    return (
        salted.withColumn(SALT, F.explode(salts)).drop("salts").repartition(buckets, *DEALT_BY)
    )


def shared_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns that a join on the order takes: the salt, too, if both sides are dealt by it."""
    return [c for c in DEALT_BY if c in left.columns and c in right.columns]


def with_salt(df: DataFrame, keys: tuple[str, ...]) -> list[str]:
    """Keys of a table with its salt, which follows from them and keeps a key in its bucket."""
    return [*keys, SALT] if SALT in df.columns else list(keys)


def once(orders: DataFrame) -> DataFrame:
    """Each order once."""
    return orders.where(F.col(SALT) <= 1) if SALT in orders.columns else orders


def totals_per_order_group(lines: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """For each key the number of different `orders`, the number of `lines`, and sums over them.

    All lines of an order lie in one bucket, so orders are told apart there; what is exchanged are
    counts by key. Orders dealt over several buckets are kept by name until they have met.
    """
    counted = {"lines": F.count(F.lit(1)), **{n: F.sum(c) for n, c in sums.items()}}
    again = [F.sum(n).alias(n) for n in counted]
    per_order = lines.groupBy(*keys, *with_salt(lines, ("order_id",))).agg(
        *[c.alias(n) for n, c in counted.items()]
    )
    if SALT not in lines.columns:
        return per_order.groupBy(*keys).agg(F.count(F.lit(1)).alias("orders"), *again)
    spread = F.when(F.col(SALT) > 0, F.col("order_id"))
    met = per_order.groupBy(*keys, spread.alias("_spread")).agg(
        F.count(F.lit(1)).alias("_n"), *again
    )
    orders = F.sum(F.when(F.col("_spread").isNull(), F.col("_n")).otherwise(1))
    return met.groupBy(*keys).agg(orders.alias("orders"), *again)
