"""Global rank, running sum and ntile without pulling all rows into one task.

A window without partition keys runs in a single task. Instead: one range-partitioned
sort, written out with each row's position inside its partition, then the partition
totals (one small row each) are added up and joined back.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# monotonically_increasing_id() holds the partition number above bit 33
# and the row number inside the partition below it.
_PARTITION_SHIFT = 33
_ROW_MASK = (1 << _PARTITION_SHIFT) - 1


def in_global_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """Sorted rows with `_pos`. The order must be unique per row, so add an id to it.

    Write the result before using it: a second run of the sort may draw other
    partition borders, and positions from two runs do not fit together.
    """
    return df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id())


def with_rank(positioned: DataFrame, running: str | None = None) -> DataFrame:
    """Adds `rn` = 1..N and `n` = N; for a `running` column also its running and total sum."""
    df = positioned.withColumn("_part", F.shiftright("_pos", _PARTITION_SHIFT))
    totals = df.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"),
        *([F.sum(running).alias("_sum")] if running else []),
    )
    # One row per sort partition, so a single task is enough and broadcasting is safe:
    # there are never more of them than shuffle partitions, a setting.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    all_parts = Window.partitionBy()
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_rows").over(all_parts).alias("n"),
        *(
            [
                F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
                F.sum("_sum").over(all_parts).alias(f"total_{running}"),
            ]
            if running
            else []
        ),
    )
    row_in_partition = F.col("_pos").bitwiseAND(F.lit(_ROW_MASK)) + F.lit(1)
    ranked = df.join(F.broadcast(offsets), "_part").withColumn(
        "rn", row_in_partition + F.col("_rows_before")
    )
    if running:
        inside = (
            Window.partitionBy("_part")
            .orderBy("_pos")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        ranked = ranked.withColumn(
            f"running_{running}", F.sum(running).over(inside) + F.col("_sum_before")
        )
    return ranked.drop("_part", "_pos", "_rows_before", "_sum_before")


def bucket_end(bucket: int, buckets: int, rows: Column) -> Column:
    """Rank of the last row of an ntile bucket; the first N % k buckets get one row more."""
    return F.floor(rows / buckets) * bucket + F.least(rows % buckets, F.lit(bucket))
