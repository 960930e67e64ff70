"""The registered queries of the corpus operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, decontaminate, hard_negatives, language, licenses, line_dedup, mixing, near_dedup, pii, pitman_yor, quality, tokens, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("blocks")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Where ``sensorloom.pii.key`` is unset: a key of this process alone, so that nobody can invert its pseudonyms; runs are linked with each other only under a key of their own.
RUN_KEY = secrets.token_bytes(32)


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("sensorloom.pii.key", None)
    found = pii.pseudonymise(_table(spark, sf_dir, "documents"), key.encode() if key else RUN_KEY)
    return found.select("doc_id", "text", "n_found", "kinds")


def op9_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archives.convert_pages(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_token_binary": op4_token_binary,
    "op5_pfair_mix": op5_pfair_mix,
    "op6_license_scan": op6_license_scan,
    "op7_decontaminate": op7_decontaminate,
    "op8_pii_pseudonyms": op8_pii_pseudonyms,
    "op9_warc_convert": op9_warc_convert,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_pitman_yor": op13_pitman_yor,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.oracle_sql(),
    "op10_quality_rules": quality.oracle_sql(),
    "op11_hard_negatives": hard_negatives.oracle_sql(),
}
