"""The corpus pipeline: language ID, near duplicates, secrets, mixing and BPE, each stage written and read again.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the columns of documents:

1. language_id labels each document; ``lang`` becomes the predicted language.  Rejected are documents without a letter and those of which
   the score is under ``LEAST_SCORE`` (letters of scripts that no learned language uses).
2. near_duplicates keeps of each group of documents, linked at a Jaccard similarity of 0.8 or more on 5-word shingles, the one of smallest id; equal
   rows count once, texts of one id are documents of their own, and rows without an id all stay.
3. secrets masks every secret in the text and counts ``n_chars`` anew; no document goes.
4. mixing repeats or leaves out documents until every source comes near its target.
5. bpe encodes each document; its rows carry the ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritrail.llm import bpe, language, mixing, near, secrets
from veritrail.runtime import materialise, prepare, table

LEAST_SCORE = 0.2
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1; see the module's text."""
    prepare(spark)
    names = docs.columns
    labelled = language.language_columns(docs, language.train(docs))
    kept = labelled.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2; see the module's text.  Texts are shuffled only of rows that may have to go: bounded bitmaps tell the others."""
    names = docs.columns
    version = F.xxhash64("text").alias("mark")
    groups = near.near_components(docs, k=5, percent=80, links=False, mark=version).where("doc_id is not null")
    first = materialise(groups.where("doc_id = component_id").groupBy("doc_id", "class").agg(F.min("mark").alias("mark")).select("doc_id", "mark").distinct(), "first")
    kept = first.withColumn("stays", F.lit(1))
    unsure = groups.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).join(kept, ["doc_id", "mark"], "left").where("n > 1 or stays is null")
    unsure = materialise(unsure.select("doc_id", "mark"), "unsure")
    rows = near.in_slots(docs.withColumn("mark", version), ["doc_id", "mark"], unsure)
    order = W.partitionBy("doc_id", "mark").orderBy("mark")
    some = rows.where("in_slots and doc_id is not null").join(first, ["doc_id", "mark"], "left_semi").withColumn("__row", F.row_number().over(order)).where("__row = 1")
    return rows.where("not in_slots or doc_id is null").select(*names).unionByName(some.select(*names))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3; see the module's text."""
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4; see the module's text."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5; see the module's text."""
    return bpe.bpe_columns(docs, VOCABULARY, ids=True)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", mask_secrets), ("mixing", mixing_stage), ("bpe", encode)]

#: Language scores and byte-pair merges are beyond SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
