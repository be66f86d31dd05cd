"""The registered queries of this subpackage: each applies one operator to a whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.llm import (
    bpe,
    decontaminate,
    language_id,
    lexical_search,
    licences,
    line_dedup,
    neighbours,
    quality,
    sharding,
    simhash,
    sql,
    substring_dedup,
    toxicity,
    vector_codes,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(_documents(spark, sf_dir), vocabulary_path())
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_by_bytes(_documents(spark, sf_dir).select("doc_id", "text"), 24)
    return sharded.select(
        "doc_id",
        F.col("shard_size").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("shard_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = language_id.fit(docs.where("NOT held_out").select("text", "lang"))
    return language_id.identify(docs.drop("lang"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected"
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), shingle_words=3, max_bits=2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir), ["doc_id"])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.shared_passages(_documents(spark, sf_dir))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.labelled(licences.scan(_documents(spark, sf_dir), ["doc_id"]), ["doc_id"])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "severity", "toxic")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontaminate.report(
        _documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"), ["doc_id"]
    )
    return report.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.encode(_table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_errors(codes).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256"
    )


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = neighbours.build(vectors)
    return neighbours.search(index, vectors.where("vec_id % 100 = 0"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build(_documents(spark, sf_dir))
    return lexical_search.search(index, _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_sharding": op2_sharding,
    "op3_language_id": op3_language_id,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_licences": op7_licences,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_vector_codes": op11_vector_codes,
    "op12_neighbours": op12_neighbours,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op9_line_dedup": sql.LINE_DEDUP,
    "op10_decontamination": sql.DECONTAMINATION,
    "op11_vector_codes": sql.VECTOR_CODES,
    "op13_lexical_search": sql.LEXICAL_SEARCH,
}
