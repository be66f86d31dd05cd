"""Intermediate tables in the folder that driver and executors share."""

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.sources.store import delete_at_exit, shared_folder

# Stands for a null id inside the operators, where ids are compared and sorted.
NO_ID = -(1 << 63)


# For tables whose rows are megabytes: Spark reads up to 4,096 rows of a row group at once.
LARGE_ROWS = {
    "parquet.block.size": 4 << 20,
    "parquet.page.size.row.check.min": 1,
    "parquet.page.size.row.check.max": 8,
}


# Texts that a Python worker gets at once; Spark's own bound is 10,000 rows, whatever their size.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lets Python workers get rows by `BATCH_BYTES`, or by what the session has if that is less.
    Executor and worker hold a batch each, and more while it grows and is converted. The setting
    stays, as a frame runs after the function that returned it."""
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    given = spark.conf.get(_BATCH_BYTES, None)
    if given is None or as_bytes(given) > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def written(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """The rows of `df`, written once and read back, so that what follows neither computes
    them again nor depends on the executors that did. The table goes when the application ends.
    `options` go to the Parquet writer.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}"
    delete_at_exit(spark, folder)
    path = f"{folder}/{name}-{uuid4().hex[:12]}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(docs: DataFrame, bytes_each: int) -> int:
    """Partitions for a sort of what the texts are cut into: one for so many bytes of text, and
    no fewer than the session's. Adaptive execution leaves a given number as it is."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-size // bytes_each), least)


def document_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What tells the rows of a documents table apart: the id, and a hash of the text.

    Rows that agree in both are the same row several times and get the same results.
    A null id is a value of its own (`NO_ID`), a null text has a hash of its own.
    """
    return [
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(F.col(text).isNull(), F.col(text)).alias("_text"),
    ]


def given_id(column: str = "_id") -> Column:
    """The id as it was given."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once for each row, however often it is used."""
    return F.transform(F.array(value), use)[0]
