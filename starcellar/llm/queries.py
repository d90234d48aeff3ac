"""The registered queries: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcellar.llm.bpe import decode, digests, encode
from starcellar.llm.decontaminate import contamination
from starcellar.llm.mixing import mixture
from starcellar.llm.periodic import best_run, periodic_runs, run_text, stretched
from starcellar.llm.quality import quality
from starcellar.llm.secret_scan import BASE_RULES, count_of, scan_secrets, span_text
from starcellar.llm.sharding import shard_documents
from starcellar.llm.simhash import simhash_groups
from starcellar.llm.substring import remove_repeats
from starcellar.llm.tables import table
from starcellar.llm.topk import top_k
from starcellar.llm.toxicity import toxicity
from starcellar.llm.url_filter import judge_urls, rule_frame
from starcellar.llm.vector_codes import vector_codes

URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), rule_frame(spark, URL_RULES))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    parsed = remove_repeats(table(spark, folder, "documents"))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(table(spark, folder, "documents"))
    kinds = [rule.kind for rule in BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id", *(count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in kinds),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode(table(spark, folder, "documents"), RANKS, PATTERN)
    return digests(decode(encoded, RANKS))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(stretched(table(spark, folder, "documents")))
    best = found.withColumn("best", best_run(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(run_text(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes(table(spark, folder, "embeddings"))


def op13_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_url_filter, op2_simhash, op3_substring_dedup, op4_secret_scan, op5_toxicity, op6_sharding, op7_byte_bpe,
        op8_quality, op9_top_k, op10_decontamination, op11_periodic_runs, op12_vector_codes, op13_mixing,
    )
}
