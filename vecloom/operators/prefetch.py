"""Page prefetching as analytics: features of ranked candidates, scoring, selection, trace labels, and a cache simulator."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

TOP = 4
POLICIES = ("none", "lru", "2q", "graph-aware-2q", "agent")
KEYS = ("query_id", "step_id", "page_id")


def page_features(candidates: DataFrame) -> DataFrame:
    """candidates: query_id, step_id, page_id, pq_rank (from 0). One row for each page of a step."""
    r = F.col("pq_rank")
    return candidates.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("num_candidates_on_page"),
        F.min(r).alias("min_pq_rank_on_page"),
        F.round(F.avg(r), 6).alias("avg_pq_rank_on_page"),
        (F.max(r) - F.min(r)).alias("candidate_rank_span"),
        F.max((r == 0).cast("int")).alias("contains_top1_candidate"),
        F.max((r < TOP).cast("int")).alias("contains_topk_candidate"),
    )


def skip_reason(cached: Column, pending: Column, ready: Column, seen: Column) -> Column:
    """Why a page needs no prefetch: the first reason that holds, or empty."""
    return F.when(cached, "cached").when(pending, "pending").when(ready, "ready").when(seen, "seen_before").otherwise("")


def submit_reason(valid: Column, demand: Column, duplicate: Column, over: Column, cached: Column, pending: Column, materialized: Column) -> Column:
    """Why a submission is refused, or empty."""
    checks = ((~valid, "invalid_page"), (demand, "demand_priority"), (duplicate, "duplicate"), (over, "budget_full"), (cached, "cached"), (pending, "pending"), (materialized, "materialized"))
    out = F.lit("")
    for when, why in reversed(checks):
        out = F.when(when, why).otherwise(out)
    return out


def budget(width: int, depth: int, io_depth: int, demand: int) -> int:
    """Submissions allowed now: what demand leaves of the queue, at most width x depth, or a quarter of the queue without a width."""
    return max(0, min(io_depth - demand, width * depth if width > 0 else max(1, io_depth // 4)))


def select_pages(features: DataFrame, width: int, min_candidates: int = 2, threshold: float = -math.inf, inflight_limit: int = 0, inflight: int = 0, allow_fallback: bool = True) -> DataFrame:
    """features with score and skip_reason (empty: available): adds prefetch_rank, selected, and the reason of those not selected.

    Ranks by score, candidates, least rank, page. Of the available pages, those with few candidates or a low score are
    passed over; of the rest, `width` are taken (0: all) while the in-flight limit (0: none) has room. If a step takes
    none, the best page that was passed over for its few candidates alone is taken, where the limit has room.
    """
    step = ["query_id", "step_id"]
    by_rank = Window.partitionBy(*step).orderBy(F.desc("score"), F.desc("num_candidates_on_page"), "min_pq_rank_on_page", "page_id")
    reason = (
        F.when(F.col("skip_reason") != "", F.col("skip_reason"))
        .when(F.col("num_candidates_on_page") < min_candidates, "low_page_reuse")
        .when(F.col("score") < threshold, "score_threshold")
        .otherwise("")
    )
    out = features.withColumn("prefetch_rank", F.row_number().over(by_rank)).withColumn("why", reason)
    eligible = F.sum((F.col("why") == "").cast("int")).over(by_rank.rowsBetween(Window.unboundedPreceding, 0))
    room = inflight_limit - inflight if inflight_limit > 0 else None
    why = F.when(F.col("why") != "", F.col("why"))
    if width > 0:
        why = why.when(F.col("eligible") > width, "budget_full")
    if room is not None:
        why = why.when(F.col("eligible") > room, "inflight_full")
    out = out.withColumn("eligible", eligible).withColumn("why", why.otherwise(""))
    taken = F.max((F.col("why") == "").cast("int")).over(Window.partitionBy(*step))
    fits = (F.col("why") == "low_page_reuse") & (F.col("score") >= threshold)
    first = F.min(F.when(fits, F.col("prefetch_rank"))).over(Window.partitionBy(*step))
    fallback = F.lit(allow_fallback and (room is None or room > 0)) & (taken == 0) & fits & (F.col("prefetch_rank") == first)
    out = out.withColumn("fallback", fallback)
    return out.withColumn("selected", (F.col("why") == "") | F.col("fallback")).withColumn("skip_reason", F.when(F.col("selected"), "").otherwise(F.col("why"))).drop("why", "eligible")


def plan(features: DataFrame, **how) -> DataFrame:
    """select_pages step by step: a page selected in an earlier step of a query is skipped as seen_before. Selection never depends on a later step, so one pass by query suffices."""
    schema = select_pages(features.limit(0), **{**how}).schema
    given = features.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rows in b.column(0).to_pylist():
                seen: set = set()
                for _, step in groupby(sorted(rows, key=lambda r: r["step_id"]), key=lambda r: r["step_id"]):
                    out += _select_step(list(step), seen, how)
            yield pa.RecordBatch.from_pylist(out, to_arrow_schema(schema))

    # The pages of a query are few, and many queries are planned in a batch.
    held = features.groupBy("query_id").agg(F.collect_list(F.struct(*given)).alias("rows"))
    return held.select("rows").mapInArrow(kernel, schema)


def _select_step(step: list[dict], seen: set, how: dict) -> list[dict]:
    width, least, threshold = how["width"], how.get("min_candidates", 2), how.get("threshold", -math.inf)
    limit = how.get("inflight_limit", 0)
    room = limit - how.get("inflight", 0) if limit > 0 else math.inf
    step.sort(key=lambda r: (-r["score"], -r["num_candidates_on_page"], r["min_pq_rank_on_page"], r["page_id"]))
    taken = 0
    for i, r in enumerate(step, 1):
        why = r["skip_reason"] or ("seen_before" if r["page_id"] in seen else "low_page_reuse" if r["num_candidates_on_page"] < least else "score_threshold" if r["score"] < threshold else "")
        why = why or ("budget_full" if 0 < width <= taken else "inflight_full" if taken >= room else "")
        taken += not why
        r |= {"prefetch_rank": i, "selected": not why, "fallback": False, "skip_reason": why}
    if not taken and room > 0 and how.get("allow_fallback", True):
        back = next((r for r in step if r["skip_reason"] == "low_page_reuse" and r["score"] >= threshold), None)
        if back:
            back |= {"selected": True, "fallback": True, "skip_reason": ""}
    seen.update(r["page_id"] for r in step if r["selected"])
    return step


def labels(trace: DataFrame) -> DataFrame:
    """Adds label, lead_steps, submit_to_demand_us and ready_before_demand_us to a trace; -1 stands for a missing time."""
    time = lambda c: F.coalesce(F.col(c), F.lit(-1))
    demanded, fetched = time("demand_time") >= 0, F.col("was_prefetched") == 1
    ready = (time("ready_time") >= 0) & (time("ready_time") <= time("demand_time"))
    label = F.when(fetched & demanded & ready, 3).when(demanded & ~fetched, 2).when(fetched & demanded, 1).otherwise(0)
    lead = F.when(demanded & (F.coalesce("demand_step_id", F.lit(-1)) >= 0), F.col("demand_step_id") - F.col("step_id")).otherwise(-1)
    gap = lambda a, b: F.when((time(a) >= 0) & (time(b) >= 0), time(b) - time(a)).otherwise(-1)
    return trace.withColumns({"label": label, "lead_steps": lead, "submit_to_demand_us": gap("submit_time", "demand_time"), "ready_before_demand_us": gap("ready_time", "demand_time")})


def page_hot_scores(node_pages: DataFrame, edges: DataFrame, threshold: int = 0) -> DataFrame:
    """page_id, hot_score: the in-degrees of its nodes, summed; hub_count: nodes with at least `threshold`."""
    indeg = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("indeg"))
    joined = node_pages.join(indeg, "id", "left").withColumn("indeg", F.coalesce("indeg", F.lit(0)))
    return joined.groupBy("page_id").agg(F.sum("indeg").alias("hot_score"), F.count_if(F.col("indeg") >= threshold).alias("hub_count"))


def eviction_score(policy: str, last_use: float, protected: bool, frequency: int, hot: float) -> float:
    """The page with the least score goes."""
    if policy == "lru":
        return last_use
    score = 1e9 * protected + last_use
    return score + 64 * math.log1p(hot) + 4 * min(frequency, 16) if policy in ("graph-aware-2q", "agent") else score


def simulate_cache(accesses: DataFrame, policy: str, capacity: int, hot: dict[int, float] | None = None) -> DataFrame:
    """accesses: stream, seq, page_id. Adds hit, by stream in order of seq. Pages enter on a miss; in the 2q family the first hit protects them."""
    if policy not in POLICIES:
        raise ValueError(f"unknown cache policy: {policy}")
    hot = hot or {}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        cache: dict[int, list] = {}
        hits = []
        for now, page in enumerate(rows["page_id"]):
            entry = cache.get(page)
            hits.append(entry is not None)
            if entry:
                entry[0], entry[2] = now, entry[2] + 1
                entry[1] = policy != "lru"
            elif policy != "none" and capacity > 0:
                if len(cache) >= capacity:
                    del cache[min(cache, key=lambda p: (eviction_score(policy, *cache[p], hot.get(p, 0.0)), p))]
                cache[page] = [now, False, 1]
        return rows.assign(hit=hits)

    schema = accesses.select("stream", "seq", "page_id", F.lit(True).alias("hit")).schema
    return accesses.select("stream", "seq", "page_id").groupBy("stream").applyInPandas(run, schema)


def page_batch(wanted: DataFrame, cached: DataFrame, pending: DataFrame) -> DataFrame:
    """Distinct wanted pages, split: page_id, state (cached, pending or missing)."""
    c, p = (df.select("page_id", F.lit(True).alias(n)).distinct() for df, n in ((cached, "c"), (pending, "p")))
    each = wanted.select("page_id").distinct().join(c, "page_id", "left").join(p, "page_id", "left")
    return each.select("page_id", F.when(F.col("c"), "cached").when(F.col("p"), "pending").otherwise("missing").alias("state"))


def query_accounting(trace: DataFrame) -> DataFrame:
    """By query: unique pages, prefetched pages, pages prefetched only, dropped and wasted submissions."""
    f, d = F.col("was_prefetched") == 1, F.col("was_demanded") == 1
    return trace.groupBy("query_id").agg(
        F.count_distinct(F.when(f | d, F.col("page_id"))).alias("unique_pages"),
        F.count_distinct(F.when(f, F.col("page_id"))).alias("prefetched_pages"),
        F.count_if(f & ~d).alias("wasted"),
        F.count_if(F.coalesce(F.col("was_evicted_before_use"), F.lit(0)) == 1).alias("dropped"),
    )
