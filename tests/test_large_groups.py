"""What only tables beyond a bound show: full buckets, several shards, deep reranking."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F
from twins import compare, views
from vecloom.operators import knn, metrics, pq
from vecloom.operators.graph import candidates as cand, index
from vecloom.plans import catalogue, oracles


@pytest.mark.parametrize("name", ["lsh_candidates", "lsh_probe1"])
def test_full_buckets_give_all_pairs(spark, tmp_path, name):
    n = 1100  # more than a limited bucket gives
    rows = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*(F.lit(float(i % 3) - 1) for i in range(64))).alias("embedding"), F.lit(0).alias("label"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.catalogue()[name](spark, str(tmp_path))
    assert got.agg(F.count(F.lit(1)), F.count_distinct("src"), F.count_if(F.col("src") == F.col("dst"))).head()[:] == (n * (n - 1), n, 0)


@pytest.mark.parametrize("radius", [0, 1])
def test_pairs_without_a_limit(spark, radius):
    rng = np.random.default_rng(2)
    base = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(rng.normal(size=(200, 6)))], "id long, v array<double>")
    pairs = lambda **x: sorted(tuple(r) for r in cand.lsh(base, 5, 4, radius, seed=7, **x).collect())
    assert pairs(bucket_limit=None) == pairs(bucket_limit=1000)


def test_packing_of_several_shards(spark, sf, monkeypatch):
    monkeypatch.setattr(index, "vamana", partial(index.vamana, shard_rows=120))
    assert catalogue._graph(spark, sf).select("shard").distinct().count() > 2
    compare(catalogue.graph_packing(spark, sf), views(sf), oracles.ORACLES["graph_packing"])


def test_reranking_grows_with_the_table(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(3000, 16)))], "id long, v array<double>").cache()
    q = base.where("id % 100 = 0").selectExpr("id AS qid", "v AS qv")
    book, truth = pq.fit(base, 4, 8), knn.exact(base, q, 10, 16)
    codes = pq.encode(base, book)
    recall = lambda: metrics.mean_recall(pq.search(base, codes, q, book, 10, 40), truth, 10).head()["recall"]
    few = recall()
    monkeypatch.setattr(pq, "DEPTH_ROWS", 100)
    assert recall() > few + 0.1
    assert pq.depth(40, 50) == 40
