"""A training corpus from documents: quality, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of documents;
the last writes the corpus as token-id files and returns what it reads back from them.  SQL cannot express the
classifier or the encoder, so ORACLE_SQL is None and tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridewave.llm.common import written
from ridewave.llm.decontaminate import decontaminate
from ridewave.llm.mixing import mix
from ridewave.llm.near_copies import keep_one_near
from ridewave.llm.quality import keep_quality
from ridewave.llm.queries import table, vocabulary_path
from ridewave.llm.token_files import token_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digest(docs, vocabulary_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing),
          ("token_output", token_output)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
