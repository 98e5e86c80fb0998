"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage reads what its predecessor wrote. The first three drop documents, the fourth masks secrets in them, and the
last turns them into packed pieces. A stage's function can be used alone, on any table with the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vecloom.llm import quality_rules, secret_scan, simhash_dedup, suffix_decontam, tier_packing
from vecloom.llm.common import materialize, owned, release, table

TOKENIZER = "word_bpe_49k.json"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def frugal(stage: Stage) -> Stage:
    """When a stage begins its predecessor's result is written, so what that stage had written on its way can go."""

    @wraps(stage)
    def run_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release("stage")
        with owned("stage"):
            return stage(spark, docs, sf_dir)

    return run_one


@frugal
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are more likely bad than good."""
    return quality_rules.keep_good(docs)


@frugal
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (0.8 on five-word shingles), the one with the smallest doc_id."""
    return simhash_dedup.keep_similar(docs)


@frugal
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return suffix_decontam.remove(docs, table(spark, sf_dir, "benchmark"))


@frugal
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in texts; n_chars follows."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@frugal
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs documents into sequences; one row for each piece."""
    return tier_packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("decontamination", decontaminate), ("secret scans", secrets), ("packing", packing)]

#: SQL has no fixed point over vote tables and no tokenizer: the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with owned(f"result {i}"):
            docs = materialize(stage(spark, docs, sf_dir), "pipeline")
        release(f"result {i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
