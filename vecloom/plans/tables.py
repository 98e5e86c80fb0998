"""The inputs of the catalogue's queries, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecloom.operators import knn

EVERY = 50
#: Pages of the derived page layout hold so many nodes.
PER_PAGE = 8
SEED = 42


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def base(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).select("id", "v")


def queries(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 50 is a query."""
    return base(spark, d).where(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), F.col("v").alias("qv"))


def log(spark: SparkSession, d: str) -> DataFrame:
    """The op log of the events: signups and purchases write a vector, errors erase; a sixth of the nodes are new to the base."""
    n = read(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    e = read(spark, d, "events").where(F.col("event_type").isin("signup", "purchase", "error")).crossJoin(F.broadcast(n))
    m = vectors(spark, d).select(F.col("id").alias("m"), F.col("v").alias("mv"))
    rows = e.select((F.col("event_id") + 1).alias("seq"), ((F.col("event_id") * 7919 + F.col("user_id")) % (F.col("n") + 100)).alias("node_id"), (F.col("event_type") == "error").alias("deleted"), ((F.col("event_id") * 31) % F.col("n")).alias("m"))
    v = F.when(~F.col("deleted"), F.col("mv"))
    return rows.join(m, "m").select("seq", "node_id", F.when(F.col("deleted"), 0).otherwise(F.size("mv")).alias("dim"), v.alias("v"), F.lit(None).cast("array<bigint>").alias("nbrs"), "deleted")


def cut(spark: SparkSession, d: str, share: int) -> int:
    """A sequence in the log: the highest event id // share."""
    return read(spark, d, "events").agg(F.max("event_id")).head()[0] // share


def top(spark: SparkSession, d: str, k: int) -> DataFrame:
    return knn.exact(vectors(spark, d), queries(spark, d), k)


def edges(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    return knn.self_graph(vectors(spark, d), k).select("src", "pos", "dst")


def ranked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of page prefetching: the 40 nearest of each query in steps of ten."""
    t = top(spark, d, 40)
    return t.select(F.col("qid").alias("query_id"), F.expr("(rk - 1) div 10").alias("step_id"), F.expr(f"id div {PER_PAGE}").alias("page_id"), ((F.col("rk") - 1) % 10).cast("long").alias("pq_rank"))


def trace(spark: SparkSession, d: str) -> DataFrame:
    """A prefetch trace whose stamps follow from arithmetic on ids."""
    from vecloom.operators import prefetch

    f = prefetch.page_features(ranked_pages(spark, d))
    q, p, s = F.col("query_id"), F.col("page_id"), F.col("step_id")
    fetched, demanded = (q + p) % 2 == 0, (q + p + s) % 3 != 0
    submit = q * 10 + s * 7 + p % 5
    return f.select(
        "*",
        F.when((q + s) % 2 == 0, "expand").otherwise("rerank").alias("trigger"),
        fetched.cast("int").alias("was_prefetched"),
        demanded.cast("int").alias("was_demanded"),
        F.when(fetched, submit).otherwise(-1).alias("submit_time"),
        F.when(fetched, submit + (p * 31 + q) % 60).otherwise(-1).alias("ready_time"),
        F.when(demanded, submit + (p * 17 + q * 3) % 80).otherwise(-1).alias("demand_time"),
        F.when(demanded, s + p % 3).otherwise(-1).alias("demand_step_id"),
        F.when(fetched & ~demanded & (p % 2 == 0), 1).otherwise(0).alias("was_evicted_before_use"),
    )


def labelled(spark: SparkSession, d: str) -> DataFrame:
    from vecloom.operators import prefetch, trace as t

    return t.with_group(prefetch.labels(trace(spark, d)))
