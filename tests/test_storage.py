"""Binary pages, records and logs, the store's memory table, and mixed runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecloom.operators import ivf, kmeans, knn, oplog
from vecloom.plans import workload
from vecloom.plans.config import EngineConfig
from vecloom.plans.engine import Engine
from vecloom.sources import datasets, log_files, pages, sinks, vector_files
from vecloom.sources.oplog_store import OplogStore

NODES = "id long, v array<double>, nbrs array<long>, codes binary"


def fnv(data):
    h = 2166136261
    for x in data:
        h = (h ^ x) * 16777619 & 0xFFFFFFFF
    return h


def test_checksum():
    for data in (b"", b"a", b"foobar", bytes(range(256))):
        assert int(pages.fnv1a(np.frombuffer(data, np.uint8)[None])[0]) == fnv(data)
    assert fnv(b"foobar") == 0xBF9CF968


def test_pages_come_back(spark):
    rows = [(i, [i + 0.5, -1.0 * i], list(range(i % 4)), bytes([i % 256] * 2 * (i % 4))) for i in range(25)]
    nodes = spark.createDataFrame(rows, NODES)
    shape = {"dim": 2, "degree": 3, "page_size": 256, "code_bytes": 2}
    slots = pages.layout(**shape)["ids"].shape[0]
    placed = nodes.selectExpr("id", f"id div {slots} AS page_id", f"cast(id % {slots} AS int) AS slot")
    made = pages.encode(nodes, placed, **shape).cache()
    assert made.count() == -(-25 // slots) and {len(r["page"]) for r in made.collect()} == {256}
    assert sorted((r["id"], r["v"], r["nbrs"], bytes(r["codes"])) for r in pages.decode(made, **shape).collect()) == [(i, v, n, c) for i, v, n, c in rows]
    assert pages.find(made, 7 // slots, 7, **shape)["v"] == [7.5, -7.0]
    with pytest.raises(ValueError):
        pages.find(made, 0, 24, **shape)
    one = pages.encode(nodes, nodes.selectExpr("id", "id AS page_id", "0 AS slot"), **shape, slots=1)
    assert one.count() == 25 and pages.decode(one, **shape, slots=1).count() == 25
    page = bytes(made.where("page_id = 0").head()["page"])
    for bad in (page[:-1], b"\1" + page[1:], page[:4] + b"\xff" + page[5:]):
        with pytest.raises(ValueError):
            pages.decode_page(bad, pages.layout(**shape), 0)
    with pytest.raises(ValueError):
        pages.layout(100, 3, 256)


def test_records(spark):
    rows = [(i, [i + 0.25] * 3, [9, 8][: i % 3], None) for i in range(9)]
    made = pages.encode_records(spark.createDataFrame(rows, NODES))
    assert sorted((r["id"], r["v"], r["nbrs"]) for r in pages.decode_records(made).collect()) == [r[:3] for r in rows]
    record = bytes(made.where("id = 5").head()["record"])
    assert len(record) == 4096 and pages.decode_record(record)[0] == 5
    for bad in (record[1:], b"x" + record[1:], record[:40] + b"\x77" + record[41:], record[:10] + b"\xff" + record[11:]):
        with pytest.raises(ValueError):
            pages.decode_record(bad)


ROWS = [{"seq": i, "node_id": i * 3, "v": None if i % 4 == 0 else [i + 0.5, 2.0], "nbrs": [1, 2] if i % 3 else None, "deleted": i % 4 == 0} for i in range(1, 10)]


def test_log_ends_at_the_first_damage():
    data = log_files.encode(ROWS)
    whole = log_files.replay(data)
    assert [(r[0], r[1], r[3], r[4], r[5]) for r in whole] == [(r["seq"], r["node_id"], r["v"], r["nbrs"], r["deleted"]) for r in ROWS]
    sizes = [len(log_files.encode([r])) for r in ROWS]
    for cut in range(0, len(data), 7):
        n = next(i for i in range(len(sizes) + 1) if sum(sizes[: i + 1]) > cut)
        assert len(log_files.replay(data[:cut])) == n
        broken = bytearray(data)
        broken[cut] ^= 255
        assert len(log_files.replay(bytes(broken))) in (n, len(ROWS))  # an id or a sequence has no checksum
    assert log_files.replay(b"") == []


def test_old_log_is_strict(spark, tmp_path):
    rows = [{"node_id": i, "v": None if i % 2 else [i, 1.5]} for i in range(6)]
    data = log_files.encode_old(rows, 2)
    assert [(r[1], r[3], r[5]) for r in log_files.replay_old(data, 2)] == [(r["node_id"], r["v"], r["v"] is None) for r in rows]
    for bad in (data[:-1], b"x" + data[1:], data[:16] + b"\7" + data[17:], data[:20]):
        with pytest.raises(ValueError):
            log_files.replay_old(bad, 2)
    with pytest.raises(ValueError):
        log_files.replay_old(data, 3)
    with pytest.raises(ValueError):
        log_files.encode_old([{"node_id": 1, "v": [1.0]}], 2)
    log_files.write(spark, data, f"file://{tmp_path}/old.log")
    assert log_files.stats(log_files.read(spark, f"file://{tmp_path}/old.log", 2)).head()[:] == (6, 3, 3, 5, 7)


def test_memory_table(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    s = OplogStore(spark, path)
    assert s.put([(1, [1.0], None, False), (2, [2.0], [1], False), (1, None, None, True)]) == 3
    assert s.memory_bytes == 48 + 48 + 4 + 8 and not s.manifest.tables and s.log().count() == 2
    again = OplogStore(spark, path)
    assert again.memory == s.memory and again.manifest.next_sequence == 4
    assert s.flush() and not s.flush() and len(s.manifest.tables) == 1 and not s._logs()
    assert OplogStore(spark, path).log().count() == 2
    small = OplogStore(spark, path, flush_bytes=100)
    small.put([(5, [1.0], None, False)])
    assert small.memory
    small.put([(6, [1.0], None, False)])
    assert not small.memory and len(small.manifest.tables) == 2
    before = small.log()
    small.compact()
    assert before.count() == 4  # a read that began before compaction ends
    assert small.disk_bytes() > 0 and len(small.manifest.retired) == 2


def test_damaged_rows_are_left_out(spark, tmp_path):
    path = f"{tmp_path}/log"
    s = OplogStore(spark, f"file://{path}")
    s.append(spark.createDataFrame([(i, i, [float(i)], None, False) for i in range(6)], "order int, node_id long, v array<double>, nbrs array<long>, deleted boolean"))
    t = s.manifest.tables[0]["path"]
    rows = spark.read.parquet(f"{path}/{t}").withColumn("v", F.when(F.col("node_id") == 3, F.array(F.lit(9.0))).otherwise(F.col("v")))
    rows.write.parquet(f"{path}/other")
    s.manifest.tables[0]["path"] = "other"
    assert sorted(r["node_id"] for r in s.log().collect()) == [0, 1, 2, 4, 5]


def test_positions_of_many_partitions(spark, tmp_path):
    s = OplogStore(spark, f"file://{tmp_path}/log")
    ops = spark.range(5000).selectExpr("-id AS order", "id AS node_id", "array(1D) AS v", "cast(null AS array<bigint>) AS nbrs", "false AS deleted").repartition(7)
    assert s.append(ops) == 5000
    assert s.log().where("seq <> 5000 - node_id").count() == 0


def test_reads_as_of(spark):
    rows = [(1, 10, [0.0], False), (2, 11, [1.0], False), (3, 10, None, True), (4, 0, [5.0], False), (5, 10, [0.5], False)]
    log = spark.createDataFrame([(s, n, 0 if v is None else 1, v, None, d) for s, n, v, d in rows], oplog.SCHEMA)
    base = spark.createDataFrame([(0, [0.25]), (1, [9.0])], "id long, v array<double>")
    reads = spark.createDataFrame([(i, [0.0], i) for i in range(6)], "qid long, qv array<double>, at long")
    want = {0: [0, 1], 1: [10, 0, 1], 2: [10, 0, 11, 1], 3: [0, 11, 1], 4: [11, 0, 1], 5: [10, 11, 0, 1]}
    for found in (oplog.exact_as_of(base, log, reads, 9, 1), oplog.merged_as_of(base, log, reads, 9, 1)):
        got = {}
        for r in found.orderBy("qid", "rk").collect():
            got.setdefault(r["qid"], []).append(r["id"])
        assert got == want
    seen = {r["at"]: (r["visible"], r["deleted"]) for r in workload.visible(log, reads.select("at").distinct()).collect()}
    assert seen == {0: (0, 0), 1: (1, 0), 2: (2, 0), 3: (1, 1), 4: (2, 1), 5: (3, 0)}


def test_large_ids_come_back(spark):
    big = (1 << 53) + 1
    base = spark.createDataFrame([(big, [1.0]), (big + 1, [2.0])], "id long, v array<double>")
    q = spark.createDataFrame([(0, [0.0])], "qid long, qv array<double>")
    assert [r["id"] for r in knn.exact(base, q, 2, 1).orderBy("rk").collect()] == [big, big + 1]


@pytest.mark.parametrize("block", [1, 7, None])
def test_search_in_blocks(spark, block):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 4, (300, 3)).astype(float)  # many ties
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(5)
    q = base.where("id < 20").selectExpr("id AS qid", "v AS qv")
    got = {(r["qid"], r["rk"]): (r["id"], r["dist"]) for r in knn.exact_blocks(base, q, 8, 3, block).collect()}
    for i in range(20):
        d = ((v - v[i]) ** 2).sum(1)
        assert [got[i, k + 1] for k in range(8)] == [(int(j), d[j]) for j in np.lexsort((np.arange(300), d))[:8]]
    assert knn.exact_blocks(base, q, 0, 3).count() == 0 and knn.exact_blocks(base, q.limit(0), 3, 3).count() == 0


def test_buckets_are_trained_anew(spark):
    base = datasets.synthetic(spark, 60, 5, 4, 3).base.cache()
    found = ivf.IvfFlat.build(base.where("id < 20"), 3)
    found.interval = 25
    one = found.insert(base.where("id BETWEEN 20 AND 39"))
    assert one.dirty == 20 and (one.centroids == found.centroids).all()
    two = one.insert(base.where("id >= 40"))
    assert two.dirty == 0 and two.rows.count() == 60 and not np.array_equal(two.centroids, one.centroids)
    few = ivf.IvfFlat(np.zeros((3, 4)), kmeans.assign(base.limit(0), np.zeros((3, 4))).drop("dist")).insert(base.limit(2))
    assert few.rows.count() == 2 and few.dirty == 0 and len(few.centroids) == 2
    with pytest.raises(ValueError):
        ivf.IvfFlat(found.centroids, found.rows, 0, 0)


def test_vector_files_anywhere(spark, tmp_path):
    rows = [[i + 0.5, 2.0 * i, -i] for i in range(50)]
    (tmp_path / "x.fvecs").write_bytes(vector_files.encode(rows))
    many = [list(range(i % 5)) for i in range(30)]
    (tmp_path / "x.ivecs").write_bytes(vector_files.encode(many, "ivecs"))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.vectors.link./in", f"file://{tmp_path}")
    for root in (f"file://{tmp_path}", "viewfs://vectors/in"):
        got = vector_files.read(spark, f"{root}/x.fvecs").orderBy("id").collect()
        assert [(r["id"], list(r["v"])) for r in got] == list(enumerate(rows))
    assert [(r["id"], list(r["v"])) for r in vector_files.read(spark, f"file://{tmp_path}/x.ivecs", "ivecs").orderBy("id").collect()] == list(enumerate(many))
    some = spark.read.format("ivecs").option("offset", 4).option("limit", 3).load(str(tmp_path / "x.ivecs"))
    assert sorted(r["id"] for r in some.collect()) == [4, 5, 6]


def test_slices(spark):
    q = spark.range(10).selectExpr("id AS qid")
    assert datasets.slice_queries(q, 8, 5).count() == 2 and datasets.slice_queries(q, 10).count() == 0 and datasets.slice_queries(q, 3, 0).count() == 7
    with pytest.raises(ValueError):
        datasets.slice_queries(q, 11)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    d = datasets.synthetic(spark, 200, 12, 8, 6)
    return Engine(spark, d.base.cache(), EngineConfig(dim=8), OplogStore(spark, f"file://{tmp_path_factory.mktemp('mixed')}/log")), d.queries.cache()


def test_concurrent_run(spark, engine):
    e, queries = engine
    r = workload.run_concurrently(e, queries, [[float(i % 7)] * 8 for i in range(40)], 10_000, 6, readers=2, k=5, compact_every=1.0)
    assert r.read_ops > 0 and r.write_ops > 0 and r.delta_record_count == r.write_ops == e.sequence()
    assert r.read_p99 >= r.read_p50 > 0 and r.write_p50 > 0 and r.compaction_attempted >= 1 and r.duration_sec >= 5
    row = workload.frame(spark, [r])
    assert len(row.columns) == 45 and row.head()["search_mode"] == "exact"


def test_results(spark, engine, tmp_path):
    e, queries = engine
    r = workload.search_result(e, queries, 5, 0.99, 2.0, {"visited": 120, "expanded": 60})
    assert r["query_count"] == 12 and r["qps"] == 6.0 and r["resident_bytes"] > 0 and r["warnings"] == []
    sinks.write_result(spark, r, str(tmp_path / "r"))
    back = workload.run_summary(sinks.read_result(spark, str(tmp_path / "r")))
    assert back["visited_per_query"] == 10 and back["recall@5"] == 0.99 and back["avg_latency_ms"] == pytest.approx(2000 / 12)
    sinks.write(workload.frame(spark, [workload.MixedResult("x")]), str(tmp_path / "m.csv"))
    assert (spark.read.option("header", True).csv(str(tmp_path / "m.csv")).columns)[:3] == ["scenario", "read_ratio", "write_ratio"]
    assert workload.summarize([]) == {"avg": 0.0, "p50": 0.0, "p95": 0.0, "p99": 0.0, "p999": 0.0}
    assert workload.summarize([float(x) for x in range(1, 11)])["p95"] == 10


def test_reads_of_few_vectors_at_many_times(spark, monkeypatch):
    """Distances are taken once for each distinct vector; every read gets what a plain search as of its time gives."""
    rng = np.random.default_rng(8)
    n, k = 3000, 4
    since = rng.integers(0, 500, n)
    rows = [(int(i // 3) * 10**12 + i % 3, x.tolist(), int(s), int(s + w)) for i, (x, s, w) in enumerate(zip(rng.integers(0, 6, (n, 3)).astype(float), since, rng.integers(0, 200, n)))]
    base = spark.createDataFrame(rows, "id long, v array<double>, since long, until long").repartition(4)
    asked = rng.integers(0, 6, (7, 3)).astype(float)
    reads = [(i, asked[i % 7].tolist(), int(a)) for i, a in enumerate(rng.integers(-5, 720, 400))]
    frame = spark.createDataFrame(reads, "qid long, qv array<double>, at long")
    want = {}
    for i, q, at in reads:
        seen = sorted((((np.array(v) - q) ** 2).sum(), x) for x, v, s, u in rows if s <= at < u)[:k]
        want |= {(i, r + 1): (x, d) for r, (d, x) in enumerate(seen)}
    for pending, block in ((1, None), (1 << 18, 2)):
        monkeypatch.setattr(knn, "PENDING", pending)
        got = knn.exact_as_of(base, frame, k, 3, block).collect()
        assert len(got) == len(want) and {(r["qid"], r["rk"]): (r["id"], r["dist"]) for r in got} == want
    assert knn.exact_as_of(base, frame.limit(0), k, 3).count() == 0 and knn.exact_as_of(base, frame, 0, 3).count() == 0


def test_a_vector_is_searched_once(spark):
    frame = spark.createDataFrame([(i, [float(i % 2)], i) for i in range(10)], "qid long, qv array<double>, at long")
    base, asked = spark.createDataFrame([(5, [0.25]), (6, [2.0])], "id long, v array<double>"), []

    def search(q):
        asked.append(q.count())
        return knn.exact(base, q, 1, 1)

    found = knn.for_each(frame, search, 1)
    assert asked == [2] and sorted((r["qid"], r["id"]) for r in found.collect()) == [(i, 5) for i in range(10)]
