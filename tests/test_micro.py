"""Cases computed by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecloom.functions import stats, vectors as V
from vecloom.operators import entries, kmeans, knn, metrics, oplog, pq, prefetch, trace
from vecloom.operators.graph import kernels
from vecloom.operators.trees import Ensemble, fit_stumps

POINTS = [(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [3.0, 4.0])]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(POINTS, "id long, v array<double>")


def ranked(df):
    return [(r["id"], r["dist"]) for r in df.orderBy("rk").collect()]


def test_exact_with_ties(spark, base):
    q = spark.createDataFrame([(9, [0.0, 0.0])], "qid long, qv array<double>")
    first = [(0, 0.0), (2, 1.0), (3, 1.0)]
    for search in (lambda *a: knn.exact(*a, method="join"), knn.exact):
        assert ranked(search(base, q, 3, 2)) == first
        assert ranked(search(base, q, 10, 2)) == [*first, (1, 25.0), (4, 25.0)]
        assert ranked(search(base, q, 0, 2)) == []
    assert [(r["id"], r["dist"]) for r in knn.one(base, [0.0, 0.0], 3).collect()] == first
    assert ranked(knn.exact_blocks(base, q.union(q.withColumn("qid", F.lit(8))), 1, 2, block=1).where("qid = 9")) == first[:1]


def test_medoid_and_entries(base):
    assert entries.medoid(base) == 3
    assert entries.medoid(base, base.where("id = 3")) in (2, 0)
    assert V.evenly_spaced(10, 4) == [0, 3, 6, 9]
    assert V.evenly_spaced(10, 3) == [0, 4, 9]
    assert V.evenly_spaced(10, 1) == [0]
    assert V.evenly_spaced(10, 20) == list(range(10))
    assert entries.select(base, None, "hybrid", count=4)[0] == 3
    with pytest.raises(ValueError):
        entries.select(base, None, "other")


def test_pq_arithmetic():
    assert V.pq_offsets(10, 4) == [0, 2, 5, 7, 10]
    assert len(V.pq_offsets(10, 20)) == 11
    assert V.sample_positions(10, 4) == [0, 2, 5, 7]
    with pytest.raises(ValueError):
        pq.check(8, 2, 300)


def test_pq_round_trip(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(40)]
    base = spark.createDataFrame(rows, "id long, v array<double>")
    book = pq.fit(base, 3, 8, iterations=3)
    codes = {r["id"]: r["code"] for r in pq.encode(base, book).collect()}
    near = {r["id"]: r["v"] for r in pq.decode(pq.encode(base, book), book).collect()}
    for i, v in rows:
        assert book.decode(np.array([codes[i]]))[0].tolist() == near[i]
        table = book.table(np.array(v))
        assert math.isclose(sum(table[m, codes[i][m]] for m in range(3)), ((np.array(v) - near[i]) ** 2).sum(), abs_tol=1e-9)
    with pytest.raises(ValueError):
        book.decode(np.array([[9, 0, 0]]))


def test_robust_prune():
    v = np.array([[0.0], [1.0], [1.5], [-2.0], [3.0]])
    assert kernels.robust_prune(v, 0, [1, 2, 3, 4], 4, 1.2) == [1, 3]
    assert kernels.robust_prune(v, 0, [1, 2, 3, 4], 1, 1.2) == [1]
    assert kernels.robust_prune(v, 0, [0], 4, 1.2) == []


def test_vamana_finds_neighbours():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    edges, start = kernels.vamana(v, 12, 40)
    assert max(map(len, edges)) <= 12 and all(i not in e for i, e in enumerate(edges))
    hits = 0
    for q in rng.normal(size=(20, 8)):
        d = ((v - q) ** 2).sum(1)
        exact = lambda n, q=q: ((v[n] - q) ** 2).sum(1)
        got, expanded = kernels.search(exact, None, edges, [start], 5, width=50, beam=4)
        assert expanded <= 50
        hits += len({x for _, x in got} & set(np.argsort(d)[:5].tolist()))
        some, fewer = kernels.search(exact, None, edges, [start], 5, width=50, beam=1, early_stop=True)
        assert fewer <= 50 and len(some) == 5
        assert kernels.search(exact, None, edges, [start], 5, width=50, beam=1, patience=3)[1] <= 50
    assert hits >= 85
    without, _ = kernels.vamana(v, 12, 40, deleted=[0, 1, 2])
    assert not any({0, 1, 2} & set(e) for e in without[3:]) and without[0] == []


def test_orders_are_permutations():
    edges = [[1], [0, 2], [], [4], [3]]
    assert kernels.bfs_order(edges) == [0, 1, 2, 3, 4]
    assert sorted(kernels.coaccess_order(edges, 2)) == [0, 1, 2, 3, 4]
    assert kernels.coaccess_order(edges, 2) == kernels.coaccess_order(edges, 2)


def test_merges(spark):
    lists = "qid int, id int, dist double"
    base = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.7), (0, 3, 0.9)], lists)
    touched = spark.createDataFrame([(2,), (3,), (9,)], "id int")
    delta = spark.createDataFrame([(0, 3, 0.1), (0, 9, 0.6)], lists)
    assert ranked(knn.merge_overrides(base, touched, delta, 3)) == [(3, 0.1), (1, 0.5), (9, 0.6)]
    assert ranked(knn.merge_overrides(base, touched.where("id = 2"), delta.limit(0), 3)) == [(1, 0.5), (3, 0.9)]
    assert ranked(knn.merge_overrides(base, touched.limit(0), delta.limit(0), 3)) == [(1, 0.5), (2, 0.7), (3, 0.9)]
    a, b = spark.createDataFrame([(0, 1, 2.0), (0, 2, 3.0)], lists), spark.createDataFrame([(0, 2, 1.0), (0, 4, 5.0)], lists)
    assert ranked(knn.merge_min([a, b], 2)) == [(2, 1.0), (1, 2.0)]


def log_rows():
    return [(1, 7, 1, [1.0], None, False), (2, 8, 1, [2.0], None, False), (3, 7, 0, None, None, True), (4, 7, 1, [3.0], None, False)]


@pytest.mark.parametrize("seed", range(3))
def test_snapshots(spark, seed):
    rows = log_rows()
    random.Random(seed).shuffle(rows)
    log = spark.createDataFrame(rows, oplog.SCHEMA)
    at = lambda n: {r["node_id"]: (r["seq"], r["deleted"]) for r in oplog.latest_at(log, n).collect()}
    assert at(2) == {7: (1, False), 8: (2, False)}
    assert at(3) == {7: (3, True), 8: (2, False)}
    assert at(4) == {7: (4, False), 8: (2, False)}
    assert oplog.get(log, 7, 3).count() == 0 and oplog.get(log, 7, 3, include_deleted=True).count() == 1
    assert [tuple(r) for r in oplog.snapshot(log, 3).collect()] == [(3, 2, 1)]
    parts = oplog.tables(log.where("seq <= 3"), 2)
    assert oplog.compaction_counts(parts).head()[:] == (2, 3, 2)
    assert {(r["node_id"], r["deleted"]) for r in oplog.compact(parts).collect()} == {(7, True), (8, False)}


def test_replay_stops_at_the_first_damage(spark):
    log = oplog.with_checksum(spark.createDataFrame(log_rows(), oplog.SCHEMA))
    assert oplog.valid_prefix(log).count() == 4
    bad = log.withColumn("checksum", F.when(F.col("seq") == 3, 0).otherwise(F.col("checksum")))
    assert sorted(r["seq"] for r in oplog.valid_prefix(bad).collect()) == [1, 2]
    assert oplog.valid_prefix(log.withColumn("checksum", F.lit(None).cast("long"))).count() == 0
    assert tuple(oplog.replay_stats(log).head()) == (3, 1, 8, 5)


def test_recall(spark):
    lists = "qid int, id int, rk int"
    found = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], lists)
    truth = spark.createDataFrame([(0, 2, 1), (0, 3, 2), (0, 9, 3)], lists)
    value = lambda k, t=truth: [r["recall"] for r in metrics.recall(found, t, k).collect()]
    assert value(3) == [pytest.approx(2 / 3)]
    assert value(2) == [0.5]
    assert value(3, truth.limit(0)) == [1.0]


def test_percentiles(spark):
    ten = spark.range(1, 11).selectExpr("CAST(id AS DOUBLE) AS x")
    assert ten.agg(stats.nearest_rank("x", 0.5), stats.nearest_rank("x", 0.95)).head()[:] == (5.0, 10.0)
    assert spark.range(1, 5).agg(stats.interpolated("id", 0.95)).head()[0] == pytest.approx(3.85)


def test_budget_and_pages():
    assert V.nodes_per_page(4096, 128, 32, 32) == 2
    b = metrics.memory_budget(1_000_000, 128, 32, cache_pages=15_000)
    assert b["resident_bytes"] == 101_634_304 and round(b["resident_ratio"], 5) == 0.1985
    auto = metrics.memory_budget(1_000_000, 128, 32, budget_ratio=0.2)
    assert 0.19 < auto["resident_ratio"] <= 0.2


def test_farthest_first(spark):
    base = spark.createDataFrame([(0, [0.0]), (1, [10.0]), (2, [4.0])], "id long, v array<double>")
    assert [i for i, _ in kmeans.farthest_first(base, 2)] == [0, 1]


def test_page_features(spark):
    pages = [7, 3, 7, 9, 3, 7]
    rows = spark.createDataFrame([(1, 1, p, i) for i, p in enumerate(pages)], "query_id long, step_id long, page_id long, pq_rank long")
    found = {r["page_id"]: tuple(r)[3:] for r in prefetch.page_features(rows).collect()}
    assert found == {7: (3, 0, 2.333333, 5, 1, 1), 3: (2, 1, 2.5, 3, 0, 1), 9: (1, 3, 3.0, 0, 0, 1)}


def test_tree_scores(spark):
    text = "base_score=0.5\nbooster[0]:\n0:[x<2] yes=1,no=2,missing=2\n1:leaf=0.1\n2:leaf=-0.2\n"
    model = Ensemble.parse(text)
    assert Ensemble.parse(model.dump()) == model
    rows = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,), (float("inf"),)], "x double")
    assert [round(r[0], 6) for r in rows.select(model.score(["x"])).collect()] == [0.6, 0.3, 0.3, 0.3, 0.3]
    with pytest.raises(ValueError):
        Ensemble.parse("booster[0]:\n0:[x<2] yes=1,no=2,missing=2\n")


def test_stumps_lower_the_error(spark):
    rows = spark.range(100).selectExpr("CAST(id AS DOUBLE) AS x", "CASE WHEN id < 40 THEN 1D ELSE 3D END AS label")
    model = fit_stumps(rows, "label", ["x"], 8, 0.5)
    e = rows.select(F.avg(F.pow(F.col("label") - model.score(["x"]), F.lit(2)))).head()[0]
    assert len(model.trees) == 8 and e < 0.05


def test_ndcg(spark):
    labels = [("g", 1, 3, 4.0), ("g", 2, 0, 3.0), ("g", 3, 1, 2.0), ("g", 4, 2, 1.0)]
    rows = spark.createDataFrame(labels, "group_id string, page_id int, label int, score double")
    assert trace.ranking_quality(rows, 3).head()["ndcg"] == pytest.approx(0.798485, abs=1e-6)


def test_trace_label_and_summary_differ_on_equal_times(spark):
    row = spark.createDataFrame([(1, 1, 1, 1, 3, 5, 5, 2, 0)], "query_id int, step_id int, was_prefetched int, was_demanded int, submit_time int, ready_time int, demand_time int, demand_step_id int, was_evicted_before_use int")
    assert prefetch.labels(row).head()["label"] == 3
    assert trace.summary(row).head()["pending_hits"] == 1
    assert trace.diagnostics(trace.summary(row)).head()["diagnostics"]


def test_raw_traces_are_read_leniently(spark):
    raw = spark.createDataFrame([("1", " 2 ", "yes", "", "7.0")], "query string, step string, prefetched string, prefetch_submit_time string, demand_time string")
    r = trace.normalized(raw).head()
    assert (r["query_id"], r["step_id"], r["was_prefetched"], r["submit_time"], r["demand_time"], r["was_demanded"]) == (1, 2, 1, None, 7, 0)
    assert stats.missing(raw, trace.ALIASES) == ["trigger", "ready_time", "was_demanded", "was_evicted_before_use"]


def test_scenarios():
    assert metrics.scenario(read=3, write=1) == {"custom": (0.75, 0.25)}
    assert metrics.scenario(read=0.9)["custom"][1] == pytest.approx(0.1)
    assert metrics.scenario("balanced") == {"balanced": (0.7, 0.3)}
    with pytest.raises(ValueError):
        metrics.scenario("none")


def test_selection_agrees_with_the_stepwise_plan(spark):
    rows = [(1, 1, p, n, r, float(s), "cached" if p == 5 else "") for p, n, r, s in ((1, 3, 0, 2), (2, 1, 1, 5), (3, 2, 2, 2), (5, 4, 0, 9), (6, 2, 3, 1))]
    f = spark.createDataFrame(rows, "query_id long, step_id long, page_id long, num_candidates_on_page long, min_pq_rank_on_page long, score double, skip_reason string")
    one = {r["page_id"]: (r["selected"], r["skip_reason"]) for r in prefetch.select_pages(f, 1, 2, 0.5).collect()}
    assert one == {1: (True, ""), 2: (False, "low_page_reuse"), 3: (False, "budget_full"), 5: (False, "cached"), 6: (False, "budget_full")}
    assert {r["page_id"]: (r["selected"], r["skip_reason"]) for r in prefetch.plan(f, width=1, min_candidates=2, threshold=0.5).collect()} == one
    back = {r["page_id"]: r["selected"] for r in prefetch.select_pages(f, 1, 9, 0.5).collect()}
    assert back == {1: False, 2: True, 3: False, 5: False, 6: False}
    again = prefetch.plan(f.union(f.withColumn("step_id", F.lit(2))), width=1, min_candidates=2, threshold=0.5)
    assert {r["page_id"]: r["skip_reason"] for r in again.where("step_id = 2").collect()}[1] == "seen_before"


def test_cache_policies(spark):
    pages = [1, 2, 1, 3, 1, 2]
    rows = spark.createDataFrame([(0, i, p) for i, p in enumerate(pages)], "stream int, seq int, page_id int")
    hits = lambda policy, n=2: [r["hit"] for r in prefetch.simulate_cache(rows, policy, n).orderBy("seq").collect()]
    assert hits("none") == [False] * 6
    assert hits("lru") == [False, False, True, False, True, False]
    assert hits("lru", 3) == [False, False, True, False, True, True]
    with pytest.raises(ValueError):
        hits("fifo")


def test_mixer_is_murmurs(spark):
    def mix(x):
        x ^= x >> 16
        x = x * 0x85EBCA6B & 0xFFFFFFFF
        x ^= x >> 13
        x = x * 0xC2B2AE35 & 0xFFFFFFFF
        return x ^ x >> 16

    xs = [0, 1, 12345, 2**31, 2**32 - 1]
    rows = spark.createDataFrame([(x,) for x in xs], "x long").select("x", V.mix_u32("x").alias("m")).collect()
    assert {r["x"]: r["m"] for r in rows} == {x: mix(x) for x in xs}


def test_medoids_of_all_vectors(spark, monkeypatch):
    """Without a sample every vector counts, however many there are."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 4))
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(5)
    for iterations in (1, 3):
        want = entries.cluster_medoids(base, list(range(300)), 7, iterations)
        assert entries.cluster_medoids(base, None, 7, iterations) == want
        assert entries.cluster_medoids(base, None, 7, iterations, set(want[:2])) == entries.cluster_medoids(base, list(range(300)), 7, iterations, set(want[:2]))
    assert entries.cluster_medoids(base, None, 1, 1)[0] == entries.medoid(base)
    assert entries.cluster_medoids(base.limit(0), None, 7, 1) == []
    monkeypatch.setattr(entries, "SAMPLE_MOST", 50)
    assert entries.cluster_medoids(base, None, 7, 3) == want


def test_medoids_query_beyond_the_sample(spark, sf, monkeypatch):
    from twins import compare, views
    from vecloom.plans import catalogue, oracles

    monkeypatch.setattr(entries, "SAMPLE_MOST", 100)
    compare(catalogue.cluster_medoids_one_iteration(spark, sf), views(sf), oracles.ORACLES["cluster_medoids_one_iteration"])
