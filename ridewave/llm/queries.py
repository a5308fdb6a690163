"""The registered queries of the corpus operators and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridewave.llm import decontaminate, hard_negatives, line_dedup, mixing, quality_rules
from ridewave.llm.decontaminate import contamination
from ridewave.llm.fingerprints import document_fingerprints
from ridewave.llm.html_text import extract_text
from ridewave.llm.periodic_runs import run_digest
from ridewave.llm.quality import quality_scores
from ridewave.llm.secret_scan import secret_digest
from ridewave.llm.simhash import near_duplicates
from ridewave.llm.substring_dedup import substring_dedup
from ridewave.llm.token_files import token_digest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": lambda spark, d: substring_dedup(table(spark, d, "documents")),
    "op2_line_dedup": _line_dedup,
    "op3_source_mixing": lambda spark, d: mixing.mixing_plan(table(spark, d, "documents")),
    "op4_simhash_near_dedup": lambda spark, d: near_duplicates(table(spark, d, "documents")),
    "op5_document_fingerprints": lambda spark, d: document_fingerprints(table(spark, d, "documents")),
    "op6_html_extraction": lambda spark, d: extract_text(table(spark, d, "pages")),
    "op7_secret_scan": lambda spark, d: secret_digest(table(spark, d, "documents")),
    "op8_token_files": lambda spark, d: token_digest(table(spark, d, "documents"), vocabulary_path()),
    "op9_decontamination": lambda spark, d: contamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op10_quality_classifier": lambda spark, d: quality_scores(table(spark, d, "documents"), table(spark, d, "labels")),
    "op11_quality_rules": lambda spark, d: quality_rules.quality_rules(table(spark, d, "documents")),
    "op12_periodic_runs": lambda spark, d: run_digest(table(spark, d, "documents")),
    "op13_hard_negatives": lambda spark, d: hard_negatives.mined(table(spark, d, "embeddings")),
}

SQL = {"op2_line_dedup": line_dedup.SQL, "op3_source_mixing": mixing.SQL, "op9_decontamination": decontaminate.SQL,
       "op11_quality_rules": quality_rules.SQL, "op13_hard_negatives": hard_negatives.SQL}
