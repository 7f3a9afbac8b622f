"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import audio, bpe, decontam, extraction, imatch, language, merge, mixing, near, quality, secrets, urls, whiten

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.text_columns(table(spark, sf_dir, "pages"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.train(documents.where(~language.held_out(F.col("doc_id"))))
    return language.language_columns(documents.withColumn("held_out", language.held_out(F.col("doc_id"))), model, keep=["doc_id", "held_out"])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_columns(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_columns(table(spark, sf_dir, "documents"))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_columns(table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_components(table(spark, sf_dir, "documents"), k=3, percent=90, links=False)


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_columns(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_columns(table(spark, sf_dir, "documents"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitening(table(spark, sf_dir, "embeddings"))


def op13_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_branches(table(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4 that SQL can express: hosts, paths and fixed rules of all pages."""
    return urls.rule_columns(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_extract, op2_language, op3_quality, op4_urls, op5_bpe, op6_mix, op7_audio, op8_jaccard, op9_imatch, op10_secrets, op11_winnowing, op12_whitening, op13_merge, url_rules)
}
ORACLE_SQL: dict[str, str] = {"op6_mix": mixing.ORACLE, "op8_jaccard": near.ORACLE, "op11_winnowing": decontam.ORACLE, "op13_merge": merge.ORACLE, "url_rules": urls.ORACLE_RULES}
