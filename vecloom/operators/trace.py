"""Analytics of prefetch traces: summaries, splits, ranking quality and policy replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vecloom.functions.stats import as_bool, as_double, as_long, first_of, gain, missing, nearest_rank

#: Column names that traces have used, the first that a trace has counts.
ALIASES = {
    "query_id": ("query_id", "qid", "query"),
    "step_id": ("step_id", "step"),
    "trigger": ("trigger", "prefetch_trigger"),
    "submit_time": ("prefetch_submit_time", "submit_time", "submit_time_us"),
    "ready_time": ("prefetch_ready_time", "ready_time", "ready_time_us"),
    "demand_time": ("demand_time", "demand_time_us", "access_time", "demand_access_time", "first_demand_time"),
    "was_prefetched": ("was_prefetched", "prefetched", "prefetch_submitted"),
    "was_demanded": ("was_demanded", "demanded", "was_used", "used"),
    "was_evicted_before_use": ("was_evicted_before_use", "evicted_before_use", "prefetch_dropped", "dropped"),
}
#: Further ones, which an analysis can do without.
FURTHER = {
    "was_ready_before_demand": ("was_ready_before_demand", "ready_before_demand", "prefetch_ready_hit"),
    "label": ("label", "prefetch_label"),
}
#: Queries are ranked in 2**SPLIT_BITS cells.
SPLIT_BITS = 12
#: Least ready, most unused, most late and least overlap share of a healthy trace.
LIMITS = {"ready_rate": 0.5, "unused_rate": 0.3, "pending_rate": 0.5, "overlap_rate": 0.3}


def normalized(raw: DataFrame) -> DataFrame:
    """A raw trace with typed columns under their first names; missing ones are null, missing flags 0."""
    out = {}
    for name, names in ALIASES.items():
        c = first_of(raw, names)
        out[name] = c if name == "trigger" else F.coalesce(as_bool(c), F.lit(False)).cast("int") if name.startswith("was_") else as_long(c)
    return raw.select(*(c for c in raw.columns if c not in out), *(c.alias(n) for n, c in out.items()))


def analysis(raw: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, rates and lead times of a raw trace, over all or by logical columns (query_id, trigger).

    A submission is a set flag or a submit time, a demand a set flag, a demand time or a label over 0. A page was ready
    if its time is before its demand, or where a time is missing, if its flag says so. The lead is the time between.
    """
    c = {name: first_of(raw, names) for name, names in {**ALIASES, **FURTHER}.items()}
    flag = lambda name: F.coalesce(as_bool(c[name]), F.lit(False))
    submit, ready, demand = (as_double(c[n]) for n in ("submit_time", "ready_time", "demand_time"))
    f = flag("was_prefetched") | submit.isNotNull()
    d = flag("was_demanded") | demand.isNotNull() | F.coalesce(as_long(c["label"]) > 0, F.lit(False))
    timely = F.coalesce(ready < demand, flag("was_ready_before_demand"))
    group = {"query_id": as_long(c["query_id"]), "trigger": F.coalesce(F.nullif(c["trigger"], F.lit("")), F.lit("unknown"))}
    rows = raw.select(
        *(group[n].alias(n) for n in by or []),
        as_long(c["query_id"]).alias("q"), f.alias("f"), d.alias("d"), (f & ready.isNotNull()).alias("r"),
        (f & flag("was_evicted_before_use")).alias("x"), (f & d & timely).alias("t"), F.when(f & d & timely, demand - ready).alias("lead"),
    )
    out = rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.nullif(F.count_distinct("q"), F.lit(0)).alias("queries"),
        F.count_if("f").alias("prefetch_submitted"),
        F.count_if("r").alias("prefetch_ready"),
        F.count_if(F.col("f") & F.col("d")).alias("prefetch_used"),
        F.count_if("t").alias("prefetch_ready_before_demand"),
        F.count_if(F.col("f") & F.col("d") & ~F.col("t")).alias("prefetch_pending_at_demand"),
        F.count_if(F.col("f") & ~F.col("d")).alias("prefetch_unused"),
        F.count_if("x").alias("prefetch_dropped"),
        F.round(F.avg("lead"), 6).alias("avg_lead_time_us"),
        *(F.round(nearest_rank("lead", p), 6).alias(f"{n}_lead_time_us") for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))),
    )
    share = {"ready_hit_rate": ("prefetch_ready_before_demand", "prefetch_submitted"), "pending_hit_rate": ("prefetch_pending_at_demand", "prefetch_used"), "useful_rate": ("prefetch_used", "prefetch_submitted"), "waste_rate": ("prefetch_unused", "prefetch_submitted"), "drop_rate": ("prefetch_dropped", "prefetch_submitted")}
    return out.withColumns({n: F.round(F.try_divide(F.col(a), F.col(b)), 6) for n, (a, b) in share.items()})


def analysis_report(raw: DataFrame, by: list[str] | None = None) -> str:
    """The analysis as Markdown, with the wanted columns that the trace doesn't have."""
    lacking = missing(raw, {n: ALIASES[n] for n in ("query_id", "was_prefetched", "ready_time", "demand_time", "was_demanded", "was_evicted_before_use")})
    parts = [markdown(analysis(raw), "Global")] + [markdown(analysis(raw, [n]).orderBy(n), f"By {n}") for n in by or []]
    return "\n".join([*parts, *([f"Columns that are missing: {', '.join(lacking)}\n"] if lacking else [])])


def summary(trace: DataFrame, by: list[Column | str] | None = None) -> DataFrame:
    """Counts and rates of submissions. A page is ready if its time is before its demand, strictly."""
    f, d = F.col("was_prefetched") == 1, F.col("was_demanded") == 1
    time = lambda c: F.coalesce(F.col(c), F.lit(-1))
    ready = f & d & (time("ready_time") >= 0) & (time("ready_time") < time("demand_time"))
    lead = F.when(f & d & (time("submit_time") >= 0) & (time("demand_time") >= 0), time("demand_time") - time("submit_time"))
    out = trace.withColumn("lead", lead.cast("double")).groupBy(*(by or [])).agg(
        F.count_if(f).alias("submitted"),
        F.count_if(f & (time("ready_time") >= 0)).alias("ready"),
        F.count_if(f & d).alias("used"),
        F.count_if(f & ~d).alias("unused"),
        F.count_if(F.coalesce(F.col("was_evicted_before_use"), F.lit(0)) == 1).alias("dropped"),
        F.count_if(ready).alias("ready_hits"),
        F.count_if(f & d & ~ready).alias("pending_hits"),
        F.count_if(F.col("lead") > 0).alias("overlap"),
        F.round(F.avg("lead"), 6).alias("lead_avg"),
        *(F.round(nearest_rank("lead", p), 6).alias(n) for p, n in ((0.5, "lead_p50"), (0.95, "lead_p95"), (0.99, "lead_p99"))),
    )
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return out.withColumns({"used_rate": rate("used", "submitted"), "unused_rate": rate("unused", "submitted"), "ready_rate": rate("ready_hits", "used"), "pending_rate": rate("pending_hits", "used"), "overlap_rate": rate("overlap", "submitted")})


def diagnostics(summaries: DataFrame) -> DataFrame:
    """Adds what is wrong with each summary, by LIMITS."""
    n = F.col("submitted") > 0
    found = F.array_compact(F.array(
        F.when(~n, "no prefetch was submitted"),
        F.when(n & (F.col("ready_rate") < LIMITS["ready_rate"]), "few prefetches are ready in time"),
        F.when(n & (F.col("unused_rate") > LIMITS["unused_rate"]), "many prefetches are never used"),
        F.when(n & (F.col("pending_rate") > LIMITS["pending_rate"]), "many demands wait for a prefetch"),
        F.when(n & (F.col("overlap_rate") < LIMITS["overlap_rate"]), "little time is overlapped"),
    ))
    return summaries.withColumn("diagnostics", found)


def with_group(trace: DataFrame) -> DataFrame:
    """group_id, or query_step where it is blank."""
    own = F.when(F.trim("group_id") != "", F.col("group_id")) if "group_id" in trace.columns else F.lit(None).cast("string")
    return trace.withColumn("group_id", F.coalesce(own, F.concat_ws("_", F.col("query_id").cast("string"), F.col("step_id").cast("string"))))


def split(trace: DataFrame, train: int = 3000, valid: int = 1000, test: int = 1000, seed: int = 42) -> DataFrame:
    """Adds part (train, valid, test) by query: of n queries the counts as given if they suffice, else in proportion, and 60/20/20 if they are all 0. Under three queries all rows are training rows."""
    ids = trace.select("query_id").distinct()
    n = ids.count()
    total = train + valid + test
    if n < 3:
        return trace.withColumn("part", F.lit("train"))
    if not total:
        a, b = max(1, n * 6 // 10), max(1, n * 2 // 10)
    elif n >= total:
        a, b, n = train, valid, total
    else:
        a, b = max(1, n * train // total), max(1, n * valid // total)
    # Ranks by hash without a sort of all: counts of the hash's leading bits give each cell its first rank.
    cells = ids.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "query_id"), 1)).withColumn("cell", F.shiftright("h", 63 - SPLIT_BITS))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("cell", (F.sum("size").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("cell").orderBy("h", "query_id"))
    ranked = cells.withColumn("inside", inside).join(F.broadcast(before), "cell").withColumn("i", F.col("before") + F.col("inside"))
    part = F.when(F.col("i") <= a, "train").when(F.col("i") <= a + b, "valid").when(F.col("i") <= n, "test")
    return trace.join(ranked.select("query_id", part.alias("part")), "query_id").where("part is not null")


def top_per_group(trace: DataFrame, k: int, score: str = "score", threshold: float | None = None) -> DataFrame:
    """Rank within the group by score, then page; chosen: the first k, above the threshold if one is given."""
    w = Window.partitionBy("group_id").orderBy(F.desc(score), "page_id")
    out = trace.withColumn("i", F.row_number().over(w))
    return out.withColumn("chosen", (F.col("i") <= k) & (F.lit(True) if threshold is None else F.col(score) >= threshold))


def ranking_quality(trace: DataFrame, k: int = 8, score: str = "score", threshold: float | None = None) -> DataFrame:
    """Means over groups of NDCG@k, precision and recall (label > 0 is relevant), and rates of labels among the chosen."""
    ideal = Window.partitionBy("group_id").orderBy(F.desc("label"), "page_id")
    rows = top_per_group(trace, k, score, threshold).withColumn("best", F.row_number().over(ideal))
    hit = F.col("label") > 0
    per = rows.groupBy("group_id").agg(
        F.sum(F.when(F.col("chosen"), gain(F.col("label"), F.col("i"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("best") <= k, gain(F.col("label"), F.col("best"))).otherwise(0.0)).alias("ideal"),
        F.count_if("chosen").alias("n"),
        F.count_if(F.col("chosen") & hit).alias("hits"),
        F.count_if(hit).alias("relevant"),
        *(F.count_if(F.col("chosen") & (F.col("label") == v)).alias(name) for v, name in ((3, "ready"), (1, "late"), (0, "unused"))),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return per.agg(
        F.count(F.lit(1)).alias("groups"),
        F.round(F.avg(share("dcg", "ideal")), 6).alias("ndcg"),
        F.round(F.avg(share("hits", "n")), 6).alias("precision"),
        F.round(F.avg(share("hits", "relevant")), 6).alias("recall"),
        *(F.round(F.coalesce(F.try_divide(F.sum(c), F.sum("n")), F.lit(0.0)), 6).alias(f"{c}_rate") for c in ("ready", "late", "unused")),
    )


def oracle_score() -> Column:
    """What a policy that knows the trace would rank by: demanded pages first, then by label and rank."""
    return 10_000.0 * F.col("was_demanded") + 100.0 * F.col("label") - F.col("min_pq_rank_on_page")


def replay(trace: DataFrame, k: int, score: Column) -> DataFrame:
    """A policy that takes the k best of each group: selected, useful, demanded, precision and recall over all groups."""
    rows = top_per_group(trace.withColumn("score", score), k)
    return rows.agg(
        F.count_if("chosen").alias("selected"),
        F.count_if(F.col("chosen") & (F.col("was_demanded") == 1)).alias("useful"),
        F.count_if(F.col("was_demanded") == 1).alias("demanded"),
    ).select(
        "selected", "useful", "demanded",
        F.round(F.coalesce(F.try_divide("useful", "selected"), F.lit(0.0)), 6).alias("precision"),
        F.round(F.coalesce(F.try_divide("useful", "demanded"), F.lit(0.0)), 6).alias("recall"),
    )


def oracle_gap(trace: DataFrame, k: int, scores: dict[str, Column]) -> DataFrame:
    """Replays policies and the oracle: policy, precision, recall, gap (of recall to the oracle's)."""
    runs = None
    for name, score in {**scores, "oracle": oracle_score()}.items():
        one = replay(trace, k, score).select(F.lit(name).alias("policy"), "precision", "recall")
        runs = one if runs is None else runs.unionByName(one)
    best = runs.where("policy = 'oracle'").select(F.col("recall").alias("most"))
    return runs.crossJoin(F.broadcast(best)).select("policy", "precision", "recall", F.round(F.col("most") - F.col("recall"), 6).alias("gap"))


def markdown(rows: DataFrame, title: str) -> str:
    """A report table; rows are few."""
    names = rows.columns
    body = "\n".join("| " + " | ".join(str(r[c]) for c in names) + " |" for r in rows.limit(1000).collect())
    return f"## {title}\n\n| {' | '.join(names)} |\n|{'-|' * len(names)}\n{body}\n"
