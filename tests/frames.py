"""Small hand-written staging and star frames."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql.types import StructType

from stallkeeper.sources.schemas import STAGING


def staging(spark, name, *rows):
    """Rows as dicts; columns left out are NULL."""
    names = STAGING[name].names
    return spark.createDataFrame([[row.get(c) for c in names] for row in rows], STAGING[name])


SALES = (
    "order_id string, item_seq int, order_status string, purchase_ts timestamp_ntz, "
    "delivered_ts timestamp_ntz, estimated_ts timestamp_ntz, delivery_days int, "
    "customer_id string, customer_unique_id string, customer_state string, customer_city string, "
    "product_id string, category string, seller_id string, seller_state string, "
    "price decimal(12,2), freight_value decimal(12,2), item_total decimal(14,2)"
)


def sale(order, person="u1", price="10.00", ts="2017-01-05", **more):
    row = {
        "order_id": order, "item_seq": 1, "order_status": "delivered",
        "purchase_ts": datetime.fromisoformat(ts) if ts else None,
        "customer_id": f"c{order}", "customer_unique_id": person, "customer_state": "SP",
        "category": "toys", "seller_id": "s1", "seller_state": "SP",
        "price": Decimal(price), "freight_value": Decimal("1.00"),
    }
    return {**row, **more}


def sales(spark, *rows):
    schema = StructType.fromDDL(SALES)
    return spark.createDataFrame([[row.get(c) for c in schema.names] for row in rows], schema)


def orders(spark, *rows):
    """(order_id, customer_id, status, purchase, delivered, estimated), dates as ISO text."""
    schema = (
        "order_id string, customer_id string, order_status string, purchase_ts timestamp_ntz, "
        "delivered_ts timestamp_ntz, estimated_ts timestamp_ntz"
    )

    def date(text):
        return datetime.fromisoformat(text) if text else None

    return spark.createDataFrame(
        [(o, c, status, date(p), date(d), date(e)) for o, c, status, p, d, e in rows], schema
    )


def rows(df, *columns):
    return [tuple(row) for row in (df.select(*columns) if columns else df).collect()]
