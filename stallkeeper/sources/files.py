"""Delimited files in, all-text staging tables out."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stallkeeper.sources.schemas import STAGING

CORRUPT = "_corrupt"


def read_tab_separated(
    spark: SparkSession, path: str, schema: StructType, header: bool = True
) -> DataFrame:
    """Tab separated, LF row end, no quoting. Malformed rows carry their line in `_corrupt`."""
    return (
        _tolerant_reader(spark, schema, header)
        .option("sep", "\t")
        .option("quote", "")
        .option("escape", "")
        .option("lineSep", "\n")
        .csv(path)
    )


def read_comma_separated(
    spark: SparkSession,
    path: str,
    schema: StructType,
    header: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """The upstream form: UTF-8, commas, quoted fields with doubled quotes inside.

    A quoted field may hold line ends only if `multi_line` is set, as a file cannot be split
    then; otherwise such a row is malformed, in two lines.
    """
    return (
        _tolerant_reader(spark, schema, header)
        .option("sep", ",")
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("multiLine", multi_line)
        .csv(path)
    )


def _tolerant_reader(spark: SparkSession, schema: StructType, header: bool):
    return (
        spark.read.schema(StructType([*schema.fields, StructField(CORRUPT, StringType())]))
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        # A pruned read would not look at every field, so a short or long
        # row would count as good or bad depending on the query.
        .option("columnPruning", False)
    )


def read_all(
    spark: SparkSession, paths: Mapping[str, str], comma: bool = False
) -> dict[str, DataFrame]:
    """Each staging input with its malformed rows; `paths` maps table name to file or folder."""
    read = read_comma_separated if comma else read_tab_separated
    return {name: read(spark, paths[name], STAGING[name]) for name in STAGING}


def is_rejected() -> Column:
    """Whether a row that was read is malformed."""
    return F.col(CORRUPT).isNotNull()


def accepted(loaded: DataFrame) -> DataFrame:
    return loaded.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejected(loaded: DataFrame) -> DataFrame:
    """Lines of the malformed rows.

    Split a written copy of the load: Spark refuses to read nothing but the malformed
    lines from a text file, and the file would be parsed twice.
    """
    return loaded.where(is_rejected()).select(F.col(CORRUPT).alias("line"))


def write_comma_separated(df: DataFrame, path: str) -> None:
    """The form `read_comma_separated` reads, blanks around values kept."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .csv(path)
    )


def tab_joined(columns: list[Column]) -> Column:
    """One text line per row; NULL is written as an empty field."""
    return F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in columns])
