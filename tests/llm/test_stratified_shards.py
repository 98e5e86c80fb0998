import random
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from llm_cases import edge_documents
from vecloom.llm import stratified_shards as S
from vecloom.llm.queries import op5_stratified_shards


def laws(rows, shards):
    n = len(rows)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) <= set(range(shards))
    assert max(sizes.values(), default=0) - min((sizes.get(k, 0) for k in range(shards)), default=0) <= 1
    for k, m in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(m))
    for source, total in Counter(r["source"] for r in rows).items():
        each = Counter(r["shard"] for r in rows if r["source"] == source)
        for k in range(shards):
            assert abs(each.get(k, 0) - total * sizes.get(k, 0) / n) < 2 + 2 * total / max(1, n)
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)


def test_query(spark, sf):
    rows = op5_stratified_shards(spark, sf).collect()
    laws(rows, 24)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))


@pytest.mark.parametrize("cells", [1, 16, 1024])
def test_skewed_sources(spark, cells):
    rows = [(i, f"t{i % 7}", "hot" if i % 3 else f"s{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = S.shard(df, shards=7, cells=cells).collect()
    laws(found, 7)
    hot = Counter(r["shard"] for r in found if r["source"] == "hot")
    assert max(hot.values()) - min(hot.values()) <= 4
    assert sorted(found) == sorted(S.shard(df.repartition(5), shards=7, cells=cells).collect())


def hashed(*values):
    """As Spark's xxhash64: a chain over values that aren't null; ("i", x) is an int."""
    h = 42
    for v in values:
        if v is not None:
            raw = struct.pack("<i", v[1]) if isinstance(v, tuple) else v.encode() if isinstance(v, str) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(raw, h)
    return h


def brute(rows, shards, seed=S.SEED):
    """rows: (id, text, source). The (id, size, crc, source, shard, slot) of all, by sorting everything."""
    by, order = {}, []
    for i, text, source in rows:
        raw = (text or "").encode()
        crc, size = zlib.crc32(raw), len(raw) + 8
        by.setdefault(source, []).append((hashed(("i", seed), i, crc, size, source) >> 2, i is not None, i or 0, crc, size, i))
    for source, members in by.items():
        phase = ((hashed(("i", seed + 1), source) >> 12) + 0.5) / float(1 << 52)
        for rank, (h, *_, crc, size, i) in enumerate(sorted(members, key=lambda m: m[:5]), 1):
            order.append(((rank - phase) / len(members), source is not None, source or "", h, i is not None, i or 0, crc, size, i, source))
    out = []
    for position, (*_, crc, size, i, source) in enumerate(sorted(order, key=lambda o: o[:8])):
        k = ((position + 1) * shards - 1) // len(rows)
        out.append((i, size, crc, source, k, position - k * len(rows) // shards))
    return out


@pytest.mark.parametrize("cells", [None, 4])
def test_against_sorting_everything(spark, cells):
    rng = random.Random(5)
    rows = [(rng.choice([None, n, n % 40]), rng.choice([None, "", "é", f"text {n % 9}", "x" * (n % 300)]), rng.choice([None, "hot", "hot", "hot", f"s{n % 12}"])) for n in range(900)]
    rows += [(None, "the same", "hot")] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = S.shard(df, shards=7, cells=cells).collect()
    key = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["source"], r["shard"], r["slot"]) for r in got), key=key) == sorted(brute(rows, 7), key=key)


def test_copies_are_ranked_as_runs(spark):
    """A row that is there very often is one row before the shuffle, and takes all its slots behind it."""
    n = 3 * S.RUN + 5
    df = spark.range(n + 10).selectExpr("if(id < 10, id, null) AS doc_id", "'t' AS text", "'s' AS source")
    rows = S.shard(df, shards=5).collect()
    laws(rows, 5)
    assert len(rows) == n + 10


def test_edges(spark):
    docs = edge_documents(spark)
    rows = S.shard(docs).collect()
    laws(rows, 24)
    assert len(rows) == docs.count() and {r["size"] for r in rows if r["doc_id"] == 1} == {8}
    assert S.shard(docs.limit(0)).count() == 0


def test_plan_is_native(spark, sf):
    plan = op5_stratified_shards(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
