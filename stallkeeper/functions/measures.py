"""Report arithmetic. Everything stays decimal; rounding happens once, at the end."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
PERCENT = "decimal(5,2)"

# Operands are narrowed to this first: dividing two of them keeps 14 decimals,
# while dividing wide sums would leave Spark only 6.
_OPERAND = "decimal(20,2)"


def _divided(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole.cast(_OPERAND), F.lit(Decimal("0.00")))


def ratio(part: Column, whole: Column, as_type: str = MONEY) -> Column:
    return _divided(part.cast(_OPERAND), whole).cast(as_type)


def percent(part: Column, whole: Column, as_type: str = PERCENT) -> Column:
    return _divided(F.lit(Decimal("100.0")) * part.cast(_OPERAND), whole).cast(as_type)


def count_where(condition: Column) -> Column:
    """SUM(CASE ...): NULL over no rows, and an unknown condition counts as false."""
    return F.sum(F.when(condition, 1).otherwise(0))


def month_start(ts: Column) -> Column:
    # trunc, not date_trunc: the latter returns a zoned timestamp.
    return F.trunc(ts, "MM")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def days_between(start: Column, end: Column) -> Column:
    """Midnights crossed, which is not the number of whole 24-hour spans."""
    return F.date_diff(end, start)
