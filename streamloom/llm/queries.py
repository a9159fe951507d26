"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm import oracles
from streamloom.llm.alignment import align_tokens
from streamloom.llm.fingerprints import fingerprint_edits
from streamloom.llm.html_main import extract_main_text
from streamloom.llm.langid import identify_languages
from streamloom.llm.manifest import merkle_manifest
from streamloom.llm.mixing import mix_documents
from streamloom.llm.near_dup import near_duplicates
from streamloom.llm.packing import pack_documents
from streamloom.llm.quality import judge
from streamloom.llm.sharding import shard_documents
from streamloom.llm.toxicity import score_toxicity
from streamloom.llm.url_filter import judge_urls
from streamloom.llm.warc import archived

#: Host, path and verdict of the rules that op3 applies.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = judge(_table(spark, sf_dir, "documents"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda host, path, verdict: F.struct(F.lit(host).alias("host"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict"))
    rules = spark.range(1).select(F.inline(F.array(*(rule(*r) for r in URL_RULES))))
    return judge_urls(_table(spark, sf_dir, "pages"), rules)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_table(spark, sf_dir, "pages"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(_table(spark, sf_dir, "documents"), carry=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_html_extraction,
        op3_url_filters,
        op4_minhash_near_dedup,
        op5_warc,
        op6_fingerprints,
        op7_sharding,
        op8_language_id,
        op9_source_mixing,
        op10_packing,
        op11_toxicity,
        op12_cross_tokenizer_alignment,
        op13_merkle_manifest,
    )
}

ORACLE_SQL = oracles.ORACLE_SQL
