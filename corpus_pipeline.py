"""A training-data pipeline of five stages over `documents`; each stage's rows are written and read again as the next one's.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm import line_dedup, mixing, near_dedup, queries, tokenizer, toxicity
from notegraph.llm.common import cut, read, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document of which nothing but blank lines is left goes with them."""
    small_batches(spark)
    out = line_dedup.delete_repeats(docs)
    emptied = (F.col("_n_gone") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    return out.withColumn("n_chars", F.when(F.col("_n_gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dedup.keep_one(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the tempered source, language and topic marginals."""
    return mixing.mix(docs).where("_kept").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, and whether they decode to it."""
    small_batches(spark)
    coded = tokenizer.encode(docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256)), queries.ranks(), public_tokenizers.PATTERN, ("doc_id", "lang", "source", "_sha"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("_sha")).alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("mixing", mix_sources), ("bpe", encode)]

#: The classifier of the first stage can't be written in SQL; tests/llm holds each stage and run() against plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the whole table of documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
