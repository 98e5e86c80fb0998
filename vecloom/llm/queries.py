"""The queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vecloom.llm import best_fit_packing, chat_format, quality_rules, secret_scan, simhash_dedup, stratified_shards, suffix_decontam, tier_packing, warc_revisit, zstd_language
from vecloom.llm.common import materialize, table

TOKENIZER, RANKS = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisit.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    dictionaries = zstd_language.learn(docs.where(~F.col("held_out") & F.col("lang").isNotNull()))
    return zstd_language.classify(docs, dictionaries, ["doc_id", "held_out"])


def op9_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.apply_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return scored.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


#: Two turns of conversation -7, whose texts hold other templates' control strings.
CONTROL = r"\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], turns.schema)
    return chat_format.read_back(chat_format.examples(turns.union(more)))


def op3_suffix_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = suffix_decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the blocks and reads their pieces back."""
    packed = best_fit_packing.blocks(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
    return best_fit_packing.read_pieces(materialize(packed, "packed"))


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards.shard(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.dedup(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_chat_format, op3_suffix_decontam, op4_best_fit_packing, op5_stratified_shards, op6_simhash_dedup, op7_warc_revisit, op8_zstd_language, op9_tier_packing, op10_quality_rules)}
