import numpy as np
import pytest
from vecloom.operators import knn, metrics, oplog
from vecloom.operators.graph import index
from vecloom.sources import datasets, sinks, vector_files
from vecloom.sources.oplog_store import OplogStore
from vecloom.streaming import ingest


@pytest.fixture
def vectors():
    return np.random.default_rng(0).normal(size=(50, 4)).astype("f4")


def test_fvecs(spark, tmp_path, vectors):
    path = tmp_path / "a.fvecs"
    path.write_bytes(vector_files.encode(vectors))
    vector_files.register(spark)
    rows = spark.read.format("fvecs").load(str(path)).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(50)) and np.allclose([r["v"] for r in rows], vectors)
    part = spark.read.format("fvecs").option("offset", 10).option("limit", 5).load(str(path)).orderBy("id").collect()
    assert [r["id"] for r in part] == list(range(10, 15))
    assert vector_files.from_binary(spark, str(path)).count() == 50


def test_ivecs(spark, tmp_path):
    path = tmp_path / "a.ivecs"
    path.write_bytes(vector_files.encode([[1, 2, 4_000_000_000], [7]], "ivecs"))
    vector_files.register(spark)
    assert [r["v"] for r in spark.read.format("ivecs").load(str(path)).orderBy("id").collect()] == [[1, 2, 4_000_000_000], [7]]


def test_broken_files(tmp_path, spark):
    good = vector_files.encode([[1.0, 2.0], [3.0, 4.0]])
    with pytest.raises(ValueError):
        vector_files.parse(good[:-1], "fvecs")
    with pytest.raises(ValueError):
        vector_files.parse(good + vector_files.encode([[1.0]]), "fvecs")
    with pytest.raises(ValueError):
        vector_files.parse(b"\0\0\0\0", "fvecs")
    path = tmp_path / "cut.fvecs"
    path.write_bytes(good[:-1])
    vector_files.register(spark)
    with pytest.raises(Exception, match="whole number"):
        spark.read.format("fvecs").load(str(path)).count()


def test_bundle(spark, tmp_path, vectors):
    truth = [[int(x) for x in np.argsort(((vectors - q) ** 2).sum(1))[:3]] for q in vectors[:5]]
    paths = datasets.sift_paths(str(tmp_path))
    for name, data, kind in (("base", vectors, "fvecs"), ("queries", vectors[:5], "fvecs"), ("truth", truth, "ivecs")):
        with open(paths[name], "wb") as f:
            f.write(vector_files.encode(data, kind))
    d = datasets.load(spark, **paths)
    found = knn.exact(d.base, d.queries, 3, 4)
    assert metrics.mean_recall(found, d.truth, 3).head()["recall"] == 1.0
    assert datasets.load(spark, **paths, query_offset=1, query_limit=2).queries.count() == 2
    with open(paths["truth"], "wb") as f:
        f.write(vector_files.encode([[99]] * 5, "ivecs"))
    with pytest.raises(ValueError):
        datasets.load(spark, **paths)


@pytest.mark.parametrize("workload", ["random", "agent"])
def test_synthetic(spark, workload):
    d = datasets.synthetic(spark, 200, 20, 8, 4, workload)
    datasets.check(d)
    near = knn.exact(d.base, d.queries, 1, 8).agg({"dist": "avg"}).head()[0]
    assert near < 20  # queries lie in clusters
    assert d.base.collect() == datasets.synthetic(spark, 200, 20, 8, 4, workload).base.collect()
    with pytest.raises(ValueError):
        datasets.synthetic(spark, workload="other")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "x int, y string")
    for name in ("r.json", "r.csv"):
        sinks.write(rows, str(tmp_path / name))
    assert spark.read.json(str(tmp_path / "r.json")).head().asDict() == {"x": 1, "y": "a"}
    with pytest.raises(ValueError):
        sinks.write(rows, str(tmp_path / "r.txt"))


def test_graph_files(spark, tmp_path):
    base = datasets.synthetic(spark, 120, 5, 8, 4).base
    g = index.vamana(base, index.BuildConfig(degree=8, candidate_limit=32), shard_rows=50).cache()
    assert g.select("shard").distinct().count() >= 3
    index.save(g, str(tmp_path / "g"), index.BuildConfig(degree=8))
    nodes, meta = index.load(spark, str(tmp_path / "g"))
    assert meta["vectors"] == 120 and nodes.count() == 120 and nodes.select("id").distinct().count() == 120
    assert index.covered(index.order(nodes, "bfs"), nodes)
    q = base.limit(5).selectExpr("id AS qid", "v AS qv")
    assert index.search(nodes, q, 1).where("qid = id").count() == 5
    (tmp_path / "bad" / "meta").mkdir(parents=True)
    (tmp_path / "bad" / "meta" / "x.txt").write_text("{}")
    with pytest.raises(ValueError):
        index.load(spark, str(tmp_path / "bad"))


def test_store_survives_reopening(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    ops = "order int, node_id long, v array<double>, nbrs array<long>, deleted boolean"
    s = OplogStore(spark, path)
    assert s.log().count() == 0
    assert s.append(spark.createDataFrame([(0, 7, [1.0], None, False), (1, 8, [2.0], None, False)], ops)) == 2
    assert s.append(spark.createDataFrame([(0, 7, None, None, True)], ops)) == 3
    assert OplogStore(spark, path).append(spark.createDataFrame([(0, 7, [3.0], None, False)], ops)) == 4
    s = OplogStore(spark, path)
    heads = lambda n: {(r["node_id"], r["seq"]) for r in oplog.latest_at(s.log(), n).collect()}
    assert heads(2) == {(7, 1), (8, 2)} and heads(4) == {(7, 4), (8, 2)}
    assert s.compact(retain_from=3) == {"tables_in": 3, "records_in": 4, "records_out": 4}
    assert heads(4) == {(7, 4), (8, 2)} and heads(3) == {(7, 3), (8, 2)}
    assert s.compact()["tables_in"] == 1
    s.append(spark.createDataFrame([(0, 9, [3.0], None, False)], ops))
    assert s.compact() == {"tables_in": 2, "records_in": 5, "records_out": 3}
    s = OplogStore(spark, path)
    assert {(r["node_id"], r["seq"]) for r in s.log().collect()} == {(7, 4), (8, 2), (9, 5)}
    with pytest.raises(ValueError):
        s.append(s.log())
    s.close()
    assert s.log().count() == 0
    with pytest.raises(ValueError):
        s.append(spark.createDataFrame([], ops))


def test_stream_state(spark, tmp_path):
    rows = [(i, i % 3, 1, [1.0], None, i == 5) for i in range(1, 7)]
    spark.createDataFrame(rows, oplog.SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    ingest.live_counts(ingest.ops(spark, str(tmp_path / "in"), oplog.SCHEMA), "counts", str(tmp_path / "cp")).awaitTermination()
    found = {r["node_id"]: (r["writes"], r["deleted"], r["seq"]) for r in spark.table("counts").collect()}
    assert found == {0: (2, False, 6), 1: (2, False, 4), 2: (2, True, 5)}
