"""One query for each operator of the package, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import sql
from tracewarden.llm.chat import training_windows, window_digests
from tracewarden.llm.codes import vector_codes
from tracewarden.llm.decontaminate import contamination
from tracewarden.llm.langid import identified_languages
from tracewarden.llm.mixing import mix
from tracewarden.llm.neardup import near_duplicates
from tracewarden.llm.secrets import secret_report
from tracewarden.llm.substrings import remove_repeats
from tracewarden.llm.tokens import LIMIT, prefix_counts
from tracewarden.llm.tries import prefix_trie, rebuilt
from tracewarden.llm.urls import judged_urls
from tracewarden.llm.vectors import near_duplicate_vectors
from tracewarden.llm.warc import archived
from tracewarden.session import freeze


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = archived(_table(spark, folder, "pages"))
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast("long")
    return records.select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page(F.coalesce("refers_to", F.lit(""))).alias("refers_to"),
    )


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identified_languages(_table(spark, folder, "documents"))


def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op5_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, folder, "embeddings"))


def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.struct(F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"))
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), hard["turn"].alias("turn"), hard["role"].alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return window_digests(freeze(training_windows(rows.unionByName(hard))))


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_report(_table(spark, folder, "documents"))


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return judged_urls(_table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes(_table(spark, folder, "embeddings")).drop("label")


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = prefix_counts(_table(spark, folder, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(*rebuilt(_table(spark, folder, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_language_id,
        op3_source_mixing,
        op4_substring_dedup,
        op5_embedding_near_dedup,
        op6_chat_formatting,
        op7_minhash_near_dedup,
        op8_benchmark_decontamination,
        op9_secret_scans,
        op10_url_filters,
        op11_vector_codes,
        op12_token_counts,
        op13_prefix_trie,
    )
}

ORACLES = sql.ORACLES
