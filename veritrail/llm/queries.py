"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import bpe_codec, collocations, decontaminate, lang_id, license_scan, pii, secret_scan, simhash, span_dedup, token_count, topk, url_filter, vector_codes

#: (host, path, verdict) of the URL filter.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lang_id.predict(docs, lang_id.train(docs)).drop("text_hash")


def op6_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=1024)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), license_scan.default_templates(spark))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.find(docs, secret_scan.train(secret_scan.samples(docs)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_bpe_codec": op4_bpe_codec,
        "op5_language_id": op5_language_id,
        "op6_pii_skip_chain": op6_pii_skip_chain,
        "op7_token_counts": op7_token_counts,
        "op8_exact_topk": op8_exact_topk,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_license_scan": op10_license_scan,
        "op11_secret_scan": op11_secret_scan,
        "op12_vector_codes": op12_vector_codes,
        "op13_phrase_collocations": op13_phrase_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_filter.duckdb_sql(URL_RULES),
        "op2_substring_dedup": span_dedup.duckdb_sql(),
        "op3_benchmark_decontamination": decontaminate.duckdb_sql(),
        "op8_exact_topk": topk.duckdb_sql(),
        "op10_license_scan": license_scan.duckdb_sql(),
        "op12_vector_codes": vector_codes.duckdb_sql(),
        "op13_phrase_collocations": collocations.duckdb_sql(),
    }
