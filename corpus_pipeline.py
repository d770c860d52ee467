"""From raw documents to token files: five stages, each on what the one before kept.

Every stage takes null, empty and very long texts, null and repeated ids, repeated rows, empty tables, and further columns of any name,
which all stages but the last keep. The tables of the stages and the token files stay in the shared folder; what
operators write on the way is deleted after each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sportlake.llm import decontamination, jaccard_join, mixing, quality, tokens
from sportlake.llm.common import documents, labels, scratch, shared_dir


def kept(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null, empty and blank texts are rejected; without labels the others stay."""
    return quality.good(docs, quality.fit(docs, labels(spark, sf_dir)))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id. Rows with a null id stay."""
    return jaccard_join.near_distinct(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows are told apart by id and text, so one of a repeated id can go alone."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights and in the order of the schedule; documents come once for each pass. A null source is a source; texts without words are not taken."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, read back: doc_id, start, n_tokens, ids_crc32 of each document."""
    return tokens.read_tokens(tokens.write_tokens(docs, path=kept(spark, "token-files")))


STAGES = [("quality", good), ("near-duplicates", distinct), ("decontamination", clean), ("mix", mix), ("tokens", tokenize)]

#: Classifying, searching and tokenising are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = kept(spark, f"stage-{name}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
