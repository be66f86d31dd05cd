"""One row per key, with or without a trace of the rows that went."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Columns of a traced table: the rule that dropped a row, NULL for rows that stay, and how many raw
# rows it stands for.
LOST_BY, COPIES = "lost_by", "copies"
DUPLICATE = "duplicate"


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order.

    The order should cover every column that is used later, so that the result does
    not depend on how rows arrive. Spark limits each map task to one row per key
    before the shuffle, so a key with very many copies does not become a hot task.
    """
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_nth", F.row_number().over(by_key)).where(F.col("_nth") == 1).drop("_nth")
    )


def in_order(*columns) -> list[Column]:
    """Ascending with NULLs first, stated because engines differ on it."""
    return [(F.col(c) if isinstance(c, str) else c).asc_nulls_first() for c in columns]


def first_rule(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule whose condition is true; NULL if there is none."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in rules])


def keep_first_traced(
    df: DataFrame, keys: list[str], order: list[str], dropped: Column
) -> DataFrame:
    """As `keep_first` over rows that no rule drops, in ascending order of the named columns, NULLs
    first. Rows dropped by a rule are kept apart: one for each rule and first key.

    Every raw row is counted in `copies` of exactly one row, by the same aggregate that picks the
    first, so nothing crosses the network for it. Copies are combined before the shuffle.
    """
    tagged = df.withColumn(LOST_BY, dropped)
    stays = F.col(LOST_BY).isNull()
    for key in keys[1:]:
        tagged = tagged.withColumn(key, F.when(stays, F.col(key)))
    first = F.min(F.when(stays, F.struct(*order)))
    grouped = tagged.groupBy(LOST_BY, *keys).agg(
        first.alias("_first"), F.count(F.lit(1)).alias(COPIES)
    )
    return grouped.select(*keys, "_first.*", LOST_BY, COPIES)


def traced(df: DataFrame) -> DataFrame:
    """The table with columns of a trace; rows without any stay, and stand for themselves."""
    if LOST_BY in df.columns:
        return df
    return df.withColumn(LOST_BY, F.lit(None).cast("string")).withColumn(
        COPIES, F.lit(1).cast("bigint")
    )


def kept(df: DataFrame) -> DataFrame:
    """Rows of a traced table that no rule dropped."""
    if LOST_BY not in df.columns:
        return df
    return df.where(F.col(LOST_BY).isNull()).drop(LOST_BY, COPIES)
