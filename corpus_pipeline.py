"""From raw documents to tokens in five stages, each written and read again.

All stages but the last return the columns of documents; columns beyond these are dropped, whatever
they are called. `n_chars` follows the text where a stage changes it. An empty table stays empty.
Nulls in `lang`, `source` and `n_chars` are passed on, null ids, too.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from stallkeeper.llm.queries import vocabulary_path
from stallkeeper.llm.scratch import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labelled ones among them, does not reject. Null and
    empty texts have no words and are judged as such; repeated rows are judged alike, each of them."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("NOT toxic").select(*COLUMNS)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each without the lines of which another one keeps the copy. Null texts stay
    null, empty ones empty; repeated rows, with one id, lose the same lines and none to each other.
    Of ids that hold a line the largest keeps it, null being below all others."""
    docs = docs.select(*COLUMNS)
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars.cast("bigint")).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, null being below all
    others, then of the smallest hash of its text; of repeated rows, one. Null and empty texts have
    the same fingerprint, so one of them stays."""
    return simhash.keep_one(docs.select(*COLUMNS), shingle_words=3, max_bits=2)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs. Null and empty texts have no words and stay;
    repeated rows stay or go together."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs.select(*COLUMNS), items)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, a row for each row, with digests of them and of what they decode
    to. Null and empty texts have no ids."""
    encoded = bpe.encode_documents(docs, vocabulary_path())
    return encoded.select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_shared_lines),
    ("simhash", without_near_duplicates),
    ("decontamination", without_benchmarks),
    ("byte_bpe", tokens),
]

# A fitted model, links between fingerprints and BPE are beyond SQL; tests/llm holds each stage
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
