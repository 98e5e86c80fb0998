import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from llm_cases import documents, edge_documents
from vecloom.llm import simhash_dedup as S
from vecloom.llm.components import components
from vecloom.llm.queries import op6_simhash_dedup

SPACE = "\x20\t\n\v\f\r"


def slow(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = "".join(" " if c in SPACE else c for c in low).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def brute(docs):
    ids = sorted(docs)
    fp = np.array([slow(docs[i]) for i in ids], np.uint64)
    pairs = [(ids[i], ids[i + 1 + j]) for i in range(len(ids)) for j in np.nonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 2)[0]]
    comp = groups(pairs, ids)
    return {i: (f"{int(f):016x}", comp[i]) for i, f in zip(ids, fp)}


def test_query(spark, sf):
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op6_simhash_dedup(spark, sf).collect()} == brute(documents(spark, sf))


@given(st.integers(0, 2**64 - 1), st.integers(0, 63), st.integers(0, 63))
@settings(max_examples=300, deadline=None)
def test_two_bits_share_a_key(x, a, b):
    i, k = S.keys(np.array([x, x ^ (1 << a) ^ (1 << b), x ^ (1 << a)], np.uint64))
    own = [set(k[i == j].tolist()) for j in range(3)]
    assert own[0] & own[1] and own[0] & own[2]


def test_the_code_is_perfect():
    assert set(S._WIDTH.tolist()) == {1, 6}
    x = np.arange(1 << 12) << 11
    assert len(np.unique(S._HALF[0][x & 4095] ^ S._HALF[1][x >> 12])) == 2048


@pytest.mark.parametrize("bucket", [1, 2, 16])
def test_links_of_a_crowd(spark, bucket):
    """A chain, a ball and strangers: full keys go by points, small ones by comparison."""
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(3)]
    fps = {seeds[0] ^ (1 << i) ^ (1 << j) for i in range(0, 20) for j in range(i)}
    chain = [seeds[1]]
    for i in range(30):
        chain.append(chain[-1] ^ (1 << i) ^ (1 << (i + 31)))
    fps = sorted(fps | set(chain) | {rng.getrandbits(64) for _ in range(200)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket)
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
    got = groups([(r["a"], r["b"]) for r in links.collect()], signed)
    want = groups([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2], signed)
    assert got == want


@pytest.mark.parametrize("task_links", [3, 1000])
def test_components(spark, task_links):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)]
    nodes = {x for p in pairs for x in p}
    want = {x: r for x, r in groups(pairs, nodes).items() if x != r}
    got = components(spark.createDataFrame(pairs, "a long, b long"), task_links)
    assert {r["node"]: r["root"] for r in got.collect()} == want


def test_edges(spark):
    docs = edge_documents(spark)
    rows = S.dedup(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows}
    assert by[1] == by[2] == by[5] == ("0" * 16, 1)
    assert by[None][1] is None
    left = S.keep_first(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in left.collect()) == [-1, 1, 3, 4, 4, 6]
    assert S.dedup(docs.limit(0)).count() == 0 and S.keep_first(docs.limit(0)).count() == 0
