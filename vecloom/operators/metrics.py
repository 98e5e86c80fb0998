"""Recall, latencies, budgets, workloads and comparisons."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecloom.functions.stats import nearest_rank
from vecloom.functions.vectors import aligned, nodes_per_page

#: Read and write shares of the standard scenarios.
SCENARIOS = {"read-heavy": (0.95, 0.05), "balanced": (0.70, 0.30), "write-heavy": (0.50, 0.50)}


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """qid, recall: hits in the first k over min(k, size of the truth); 1 for k = 0 or an empty truth. found: qid, id, rk; truth: qid, id, rk; both ranks from 1."""
    ids = lambda df, name: df.where(F.col("rk") <= k).groupBy("qid").agg(F.collect_set("id").alias(name))
    both = ids(found, "f").join(ids(truth, "t"), "qid", "full_outer")
    hits = F.size(F.array_intersect(F.coalesce("f", F.array().cast("array<bigint>")), F.coalesce("t", F.array().cast("array<bigint>"))))
    size = F.coalesce(F.size("t"), F.lit(0))
    return both.select("qid", F.when(size <= 0, 1.0).otherwise(hits / F.least(F.lit(k), size)).alias("recall"))


def mean_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return recall(found, truth, k).agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.round(F.avg("recall"), 6), F.lit(0.0)).alias("recall"))


def latencies(df: DataFrame, value: str, by: list[str], elapsed: str | None = None) -> DataFrame:
    """Count, mean, nearest-rank percentiles, and with elapsed (ms) queries per second."""
    out = [F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("avg_ms")]
    out += [F.round(nearest_rank(value, p), 6).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999"))]
    if elapsed:
        out.append(F.round(1000 * F.count(F.lit(1)) / F.greatest(F.sum(elapsed), F.lit(1e-9)), 6).alias("qps"))
    return df.groupBy(*by).agg(*out)


def ratios(df: DataFrame, pairs: dict[str, tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """Sums of counters and their ratios; a zero divisor counts as 1."""
    names = sorted({c for p in pairs.values() for c in p})
    total = df.groupBy(*(by or [])).agg(*(F.sum(c).alias(c) for c in names))
    return total.select(*(by or []), *names, *(F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6).alias(name) for name, (a, b) in pairs.items()))


def memory_budget(vectors: int, dim: int, subspaces: int, centroids: int = 256, workers: int = 1, cache_pages: int = 0, page_size: int = 4096, budget_ratio: float | None = None) -> dict[str, float]:
    """Resident bytes by part, as an estimate; with a ratio, the cache pages that fit in it."""
    raw = vectors * dim * 4
    codes, books, directory = vectors * subspaces, subspaces * centroids * dim * 4, vectors * 4
    fixed = codes + books + directory
    if budget_ratio is not None:
        cache_pages = max(0, int((budget_ratio * raw - fixed) // (page_size * workers)))
    cache = cache_pages * page_size * workers
    return {"code_bytes": codes, "codebook_bytes": books, "directory_bytes": directory, "cache_bytes": cache, "cache_pages": cache_pages, "resident_bytes": fixed + cache, "resident_ratio": (fixed + cache) / max(1, raw)}


def page_layout(page_size: int, dim: int, degree: int, code_bytes: int, vectors: int) -> dict[str, int]:
    per = nodes_per_page(aligned(page_size, 4096), dim, degree, code_bytes)
    if per < 1:
        raise ValueError("a node doesn't fit in a page")
    return {"per_page": per, "pages": math.ceil(vectors / per)}


def scenario(name: str | None = None, read: float | None = None, write: float | None = None) -> dict[str, tuple[float, float]]:
    """The standard scenarios, one of them, or a custom one: shares are made to add up to 1; one given alone leaves the rest to the other."""
    if read is not None or write is not None:
        r = read if read is not None else 1 - write
        w = write if write is not None else 1 - read
        if r < 0 or w < 0 or r + w <= 0:
            raise ValueError("shares must not be negative, nor both zero")
        return {"custom": (r / (r + w), w / (r + w))}
    if name is None:
        return dict(SCENARIOS)
    if name not in SCENARIOS:
        raise ValueError(f"unknown scenario: {name}")
    return {name: SCENARIOS[name]}


def scenario_frame(spark: SparkSession, chosen: dict[str, tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(n, r, w) for n, (r, w) in chosen.items()], "scenario string, read_ratio double, write_ratio double")


def sampled(df: DataFrame, share: float, seed: int = 42, id_col: str = "qid") -> DataFrame:
    """A seeded share of the queries, for recall checks during a run."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1_000_000)) < int(share * 1_000_000))


def perturbed(queries: DataFrame, seed: int = 42, spread: float = 0.01) -> DataFrame:
    """Queries with normal noise on each component, drawn from hashes so that it can be repeated."""

    def noise(i):
        u = lambda s: (F.pmod(F.xxhash64(F.lit(seed + s), "qid", i), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1)) * spread

    return queries.withColumn("qv", F.transform("qv", lambda x, i: x.cast("double") + noise(i)))


def workload(spark: SparkSession, operations: int, read_ratio: float, queries: int, first_id: int, seed: int = 42) -> DataFrame:
    """A mixed run: seq, op (read or write), qid (in turn) for reads, node_id (from first_id up) for writes."""
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    ops = spark.range(1, operations + 1).select(F.col("id").alias("seq"), F.when(u < read_ratio, "read").otherwise("write").alias("op"))
    return ops.select("seq", "op", F.when(F.col("op") == "read", (F.col("seq") - 1) % queries).alias("qid"), F.when(F.col("op") == "write", first_id + F.col("seq") - 1).alias("node_id"))


def compare(a: DataFrame, b: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """Two runs side by side: key, a, b, delta, percent."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer")
    return both.select(key, "a", "b", F.round(F.col("b") - F.col("a"), 6).alias("delta"), F.round(100 * F.try_divide(F.col("b") - F.col("a"), F.abs("a")), 6).alias("percent"))


def matrix(spark: SparkSession, parameters: dict[str, list], plan: str = "grid", base: dict | None = None) -> DataFrame:
    """Runs of an experiment, tagged: grid takes all combinations, staged varies one parameter at a time around base."""
    base = base or {k: v[0] for k, v in parameters.items()}
    if plan == "grid":
        runs = [dict(zip(parameters, c)) for c in itertools.product(*parameters.values())]
    elif plan == "staged":
        runs = [base, *({**base, k: x} for k, v in parameters.items() for x in v if x != base[k])]
    else:
        raise ValueError(f"unknown plan: {plan}")
    rows = [("_".join(f"{k}{r[k]}" for k in parameters), *(str(r[k]) for k in parameters)) for r in runs]
    return spark.createDataFrame(list(dict.fromkeys(rows)), ["tag", *parameters])


def pending(runs: DataFrame, done: DataFrame) -> DataFrame:
    """Runs whose tag has no result yet."""
    return runs.join(done.select("tag"), "tag", "left_anti")
