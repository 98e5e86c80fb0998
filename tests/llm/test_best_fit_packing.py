import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_cases import documents, edge_documents
from vecloom.llm import best_fit_packing as B
from vecloom.llm.common import materialize
from vecloom.llm.queries import op4_best_fit_packing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoded(text):
    return np.array([*B.encoding(PATH).encode_ordinary(text), B.END_ID], "<u4")


def whole(rows, ids, width):
    by, rooms = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        rooms.setdefault(r["sequence_id"], []).append(r)
    for d, x in ids.items():
        at = 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(x)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(x[r["start"] : at].tobytes())
        assert at == len(x) and len(by[d]) == -(-len(x) // width)
    for row in rooms.values():
        at = 0
        for r in sorted(row, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= width
    return len(rooms)


def test_query(spark, sf):
    ids = {d: encoded(t) for d, t in documents(spark, sf).items()}
    rows = op4_best_fit_packing(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(ids)
    n = whole(rows, ids, B.WIDTH)
    assert n * B.WIDTH <= 1.05 * sum(map(len, ids.values())) + B.WIDTH


def slow_place(lengths, width):
    rows, rooms = [], []
    pieces = []
    for d, n in enumerate(lengths):
        for s in range(0, n, width):
            pieces.append((min(width, n - s), d, s))
    for n, d, s in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if not fits:
            rooms.append(width)
            rows.append([])
            fits = [len(rooms) - 1]
        i = min(fits, key=lambda i: rooms[i])
        rooms[i] -= n
        rows[i].append((d, s, n))
    return rows


@pytest.mark.parametrize("seed", range(60))
def test_rows_are_as_full_as_by_full_search(seed):
    rng = random.Random(seed)
    width = rng.choice([1, 2, 7, 16, 100, 2048])
    lengths = [rng.randint(0, rng.choice([width, 3 * width])) for _ in range(rng.randint(0, 150))]
    got, want = B.place(lengths, width), slow_place(lengths, width)
    assert sorted(p for r in got for p in r) == sorted(p for r in want for p in r)
    fill = lambda rows: sorted(sum(n for _, _, n in r) for r in rows)
    assert fill(got) == fill(want)


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + "\n" * 300_000 + "b", ("x" + " " * 40_000) * 3 + "y", "a" * 300_000])
def test_long_runs_come_back(text):
    ids = B.encode(B.encoding(PATH), text)
    assert B.encoding(PATH).decode(ids) == text
    assert B.encode(B.encoding(PATH), text[:20_000]) == B.encoding(PATH).encode_ordinary(text[:20_000])


def test_blocks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    packed = materialize(B.blocks(docs.coalesce(1), PATH, width=64, buffer_tokens=5000), "test")
    assert packed.count() > 3
    for r in packed.collect():
        ids = np.frombuffer(r["ids"], "<u2").reshape(r["rows"], r["width"])
        cu, positions = np.frombuffer(r["cu_seqlens"], "<i4"), np.frombuffer(r["positions"], "<u2").reshape(ids.shape)
        assert cu[0] == 0 and cu[-1] == ids.size and (np.diff(cu) > 0).all() and set(range(0, ids.size, 64)) <= set(cu.tolist())
        flat = positions.ravel()
        for a, z in zip(cu, cu[1:]):
            assert flat[a:z].tolist() == list(range(z - a))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    back = {}
    for r in B.read_pieces(packed, with_ids=True).collect():
        back.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for d, parts in back.items():
        ids = [x for _, p in sorted(parts) for x in p]
        assert ids[-1] == B.END_ID and B.encoding(PATH).decode(ids[:-1]) == texts[d]
    assert set(back) == set(texts)


def test_edges(spark):
    docs = edge_documents(spark)
    rows = B.read_pieces(materialize(B.blocks(docs, PATH), "test")).collect()
    ids = {r["doc_id"]: encoded(r["text"] or "") for r in docs.collect() if r["doc_id"] != 4}
    for d, x in ids.items():
        assert sum(r["length"] for r in rows if r["doc_id"] == d) == len(x)
    assert sum(r["start"] == 0 for r in rows if r["doc_id"] == 4) == 3
    assert B.read_pieces(materialize(B.blocks(docs.limit(0), PATH), "test")).count() == 0
