import pytest
from vecloom.operators import metrics
from vecloom.operators.graph import index
from vecloom.plans.config import EngineConfig, PqConfig, SearchConfig
from vecloom.plans.engine import OPS, Engine
from vecloom.sources import datasets
from vecloom.sources.oplog_store import OplogStore


@pytest.fixture(scope="module")
def data(spark):
    d = datasets.synthetic(spark, 300, 12, 8, 6)
    return d.base.cache(), d.queries.cache()


def config(mode):
    search = SearchConfig(k=5, width=80, beam=8, rerank=40, nprobe=12, entries=8)
    return EngineConfig(mode, 8, 16, PqConfig(4, 32), index.BuildConfig(degree=12, candidate_limit=40), search)


@pytest.mark.parametrize("mode", ["exact", "graph", "pq", "ivf"])
def test_changes_are_seen(spark, data, tmp_path, mode):
    base, queries = data
    e = Engine(spark, base, config(mode), OplogStore(spark, f"file://{tmp_path}/log"))
    first = metrics.mean_recall(e.search_batch(queries).hits, e.truth(queries, 5), 5).head()["recall"]
    assert first == 1.0 if mode == "exact" else first >= 0.85
    v = list(queries.where("qid = 0").head()["qv"])
    before = e.search(v)
    assert e.insert(1000, v) == 1
    assert e.search(v)[0] == (1000, 0.0)
    assert e.erase(before[0][0]) == 2
    assert before[0][0] not in [i for i, _ in e.search(v)]
    assert e.search_batch(queries.where("qid = 0"), sequence=1).hits.where("id = 1000").count() == 1
    assert e.write_batch(spark.createDataFrame([(0, 1000, None, None, True), (1, 1001, [float(x) for x in v], None, False)], OPS)) == 4
    assert e.search(v)[0][0] == 1001
    assert e.compact()["records_out"] == 3 and e.search(v)[0][0] == 1001 and e.memory_bytes() > 0
    e.close()
    assert 1001 not in [i for i, _ in e.search(v)]


def test_checks(spark, data):
    base, _ = data
    e = Engine(spark, base, config("exact"))
    for change in (lambda: e.insert(1, [0.0] * 8), lambda: e.erase(1), lambda: e.compact()):
        with pytest.raises(ValueError, match="store"):
            change()
    with pytest.raises(ValueError):
        e.insert(1, [0.0])
    with pytest.raises(ValueError):
        EngineConfig("other")
    with pytest.raises(ValueError):
        PqConfig(centroids=1)
    s = SearchConfig(k=20, width=4, beam=9, rerank=5)
    assert (s.beam, s.rerank, len(s.warnings)) == (4, 20, 2)


def test_search_as_joins_agrees(spark, data):
    base, queries = data
    g = index.vamana(base, index.BuildConfig(degree=12, candidate_limit=40)).cache()
    entry = g.head()["entry"]
    q = queries.limit(3)
    found = index.level_search(index.edges_of(g), g.select("id", "v"), q, [entry], 5, 8, 4)
    truth = Engine(spark, base, config("exact")).truth(q, 5)
    assert metrics.mean_recall(found, truth, 5).head()["recall"] >= 0.8
    stats = index.search(g, q, 5, width=20, beam=4, stats=True).collect()
    assert all(0 < r["expanded"] <= 20 for r in stats)


def test_workload(spark, data, tmp_path):
    """A mixed run: reads see the log as of their own sequence, and memory of a node's last version is what they find."""
    ops = metrics.workload(spark, 200, 0.7, 12, 300)
    counts = {r["op"]: r["count"] for r in ops.groupBy("op").count().collect()}
    assert 110 <= counts["read"] <= 170 and counts["read"] + counts["write"] == 200
    assert ops.where("op = 'write' AND node_id < 300").count() == 0
    noisy = metrics.perturbed(data[1])
    assert noisy.count() == 12 and noisy.collect() == metrics.perturbed(data[1]).collect()
    assert 0 <= metrics.sampled(data[1], 0.5).count() <= 12 and metrics.sampled(data[1], 1.0).count() == 12


def test_matrix(spark):
    runs = metrics.matrix(spark, {"a": [1, 2], "b": [3, 4, 5]})
    assert runs.count() == 6 and metrics.matrix(spark, {"a": [1, 2], "b": [3, 4, 5]}, "staged").count() == 4
    assert metrics.pending(runs, runs.limit(2)).count() == 4
    with pytest.raises(ValueError):
        metrics.matrix(spark, {"a": [1]}, "other")
