"""Result sinks: JSON and CSV by extension, and prefetch traces that grow."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: The columns of a trace file, in order.
TRACE_COLUMNS = (
    "query_id bigint, step_id bigint, trigger string, group_id string, candidate_node_id string, candidate_page_id bigint, num_candidates_on_page bigint, "
    "min_pq_rank_on_page bigint, avg_pq_rank_on_page double, candidate_rank_span bigint, contains_top1_candidate int, contains_topk_candidate int, "
    "is_cached_at_decision int, is_inflight_at_decision int, io_queue_depth bigint, cache_pressure double, prefetch_score double, prefetch_rank bigint, "
    "selected_by_policy int, skip_reason string, was_prefetched int, prefetch_decision_time bigint, prefetch_submit_time bigint, prefetch_ready_time bigint, "
    "was_demanded int, demand_step_id bigint, demand_time bigint, lead_steps bigint, submit_to_demand_us bigint, ready_before_demand_us bigint, "
    "was_ready_before_demand int, was_evicted_before_use int, sync_fallback_used int, label int"
)


def write(rows: DataFrame, path: str, mode: str = "error") -> None:
    """A folder of JSON lines (.json) or CSV with a header (.csv)."""
    if path.endswith(".json"):
        rows.write.mode(mode).json(path)
    elif path.endswith(".csv"):
        rows.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"neither .json nor .csv: {path}")


def write_result(spark: SparkSession, result: dict, path: str) -> None:
    """One result, nested values included, as a folder of one JSON line."""
    spark.createDataFrame([(json.dumps(result, default=str),)], "value string").coalesce(1).write.text(path)


def read_result(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).head()[0])


def append_trace(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE_COLUMNS).option("header", True).csv(path)
