"""Datasets of base vectors, queries and true neighbours: loading, checking, slicing, and synthetic ones."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecloom.sources import vector_files


@dataclass
class Dataset:
    base: DataFrame  # id, v
    queries: DataFrame  # qid, qv
    truth: DataFrame | None = None  # qid, rk (from 1), id
    mode: str = "files"


def sift_paths(folder: str) -> dict[str, str]:
    return {"base": f"{folder}/sift_base.fvecs", "queries": f"{folder}/sift_query.fvecs", "truth": f"{folder}/sift_groundtruth.ivecs"}


def load(spark: SparkSession, base: str, queries: str, truth: str | None = None, base_limit: int = -1, query_offset: int = 0, query_limit: int = 0) -> Dataset:
    vector_files.register(spark)
    b = spark.read.format("fvecs").option("limit", base_limit).load(base)
    q = slice_queries(spark.read.format("fvecs").load(queries).select(F.col("id").alias("qid"), F.col("v").alias("qv")), query_offset, query_limit)
    t = None
    if truth:
        t = spark.read.format("ivecs").load(truth).select(F.col("id").alias("qid"), F.posexplode("v").alias("rk", "id")).withColumn("rk", F.col("rk") + 1)
        t = t.join(q.select("qid"), "qid", "left_semi")
    out = Dataset(b, q, t)
    check(out)
    return out


def check(d: Dataset) -> None:
    """Base and queries are there and agree in dimension; every query has a truth, of ids in the base."""
    dims = [df.agg(F.min(F.size(c)), F.max(F.size(c))).head() for df, c in ((d.base, "v"), (d.queries, "qv"))]
    if any(x[0] is None for x in dims):
        raise ValueError("base and queries must not be empty")
    if len({*dims[0], *dims[1]}) != 1:
        raise ValueError(f"dimensions differ: {dims}")
    if d.truth is not None:
        if d.queries.join(d.truth.select("qid"), "qid", "left_anti").limit(1).count():
            raise ValueError("a query has no truth")
        if d.truth.join(d.base.select("id"), "id", "left_anti").limit(1).count():
            raise ValueError("a true neighbour isn't in the base")


def slice_queries(queries: DataFrame, offset: int = 0, limit: int = 0) -> DataFrame:
    """Queries from the offset on, `limit` of them at most (0 or less: all that are left). An offset past the end is an error."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    out = queries.where(F.col("qid") >= offset)
    if offset and offset > (last := queries.agg(F.coalesce(F.max("qid") + 1, F.lit(0))).head()[0]):
        raise ValueError(f"an offset of {offset} in {last} queries")
    return out if limit <= 0 else out.where(F.col("qid") < offset + limit)


def _normal(seed: Column | int, *keys: Column) -> Column:
    """A standard normal number from hashes of its keys: the same wherever and however often it is computed."""
    u = lambda s: (F.pmod(F.xxhash64(F.lit(s), F.lit(seed) if isinstance(seed, int) else seed, *keys), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))


def synthetic(spark: SparkSession, base: int = 1000, queries: int = 100, dim: int = 32, clusters: int = 16, workload: str = "random", session_length: int = 8, seed: int = 42) -> Dataset:
    """Clustered vectors. Queries come from any cluster (random), or stay in one for a session and drift (agent)."""
    if workload not in ("random", "agent"):
        raise ValueError(f"unknown workload: {workload}")
    if min(base, queries, dim, clusters, session_length) < 1:
        raise ValueError("sizes must be positive")
    dims = F.sequence(F.lit(0), F.lit(dim - 1))
    centre = lambda c, d: 8 * _normal(seed, F.lit("centre"), c, d)
    b = spark.range(base).select("id", F.transform(dims, lambda d: (centre(F.col("id") % clusters, d) + 0.35 * _normal(seed, F.lit("base"), F.col("id"), d)).cast("float")).alias("v"))
    of = F.expr(f"id div {session_length}") % clusters if workload == "agent" else F.pmod(F.xxhash64(F.lit(seed), F.lit("pick"), "id"), F.lit(clusters))
    drift = lambda d: 0.12 * _normal(seed, F.lit("drift"), F.col("id"), d) if workload == "agent" else F.lit(0.0)
    q = spark.range(queries).withColumn("c", of)
    q = q.select(F.col("id").alias("qid"), F.transform(dims, lambda d: (centre(F.col("c"), d) + 0.45 * _normal(seed, F.lit("query"), F.col("id"), d) + drift(d)).cast("float")).alias("qv"))
    return Dataset(b, q, None, "synthetic")
