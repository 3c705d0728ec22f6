"""One thin query an operator, as ``__spark_entry__`` registers them, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plait.llm import bpe, decontaminate, flac, langid, passages, quality, secrets, simhash, suffixes, warc
from plait.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicate_classes(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_passages": op2_passages,
    "op3_flac": op3_flac,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_secrets": op7_secrets,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_suffixes": op10_suffixes,
}

SQL: dict[str, str] = {
    "op7_secrets": secrets.duckdb_sql(),
    "op8_warc": warc.DUCKDB_SQL,
}
