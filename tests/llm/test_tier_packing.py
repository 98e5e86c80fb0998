import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_cases import edge_documents
from tokenizers import Tokenizer
from vecloom.llm import tier_packing as P
from vecloom.llm.queries import op9_tier_packing
from vecloom.llm.word_tokens import Words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def whole(rows, ids):
    """ids: id arrays of the documents by doc_id, for ids that are there once."""
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    for d, x in ids.items():
        at = 0
        for r in sorted(by.pop(d), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(x) and r["length"] > 0
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(x[r["start"] : at].astype("<u4").tobytes())
        assert at == len(x)
    padding = total = 0
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and len({r["tier"] for r in pieces}) == 1 and at <= pieces[0]["tier"]
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    return by, padding, total


def test_query(spark, sf, tokenizer):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in docs.items()}
    rows = op9_tier_packing(spark, sf).collect()
    rest, padding, total = whole(rows, ids)
    assert not rest and padding < 0.03 * total
    steps = {}
    for r in rows:
        steps.setdefault(r["step_group"], {})[r["sequence_id"]] = r["tier"]
    sizes = sorted(sum(s.values()) for s in steps.values())
    assert all(P.STEP_TOKENS - 2048 <= s <= P.STEP_TOKENS + 2048 for s in sizes[1:])


def slow_pack(lengths, tiers):
    """The rules in plain lists of lengths: windows as (size, lengths), and what is left."""
    top, pools, windows = tiers[-1], [[] for _ in tiers], []

    def route(n):
        while n >= top:
            windows.append((top, [top]))
            n -= top
        if n:
            pools[[n <= t for t in tiers].index(True)].append(n)

    for n in lengths:
        route(n)

    def fill(gap, upto):
        got = []
        while gap:
            for i in range(upto, -1, -1):
                if fits := [n for n in pools[i] if n <= gap]:
                    pools[i].remove(max(fits))
                    got.append(max(fits))
                    break
            else:
                i = next(i for i in range(upto + 1) if pools[i])
                n = max(pools[i])
                pools[i].remove(n)
                got.append(gap)
                route(n - gap)
            gap -= got[-1]
        return got

    for i in reversed(range(len(tiers))):
        while pools[i]:
            first = max(pools[i])
            pools[i].remove(first)
            gap, below = tiers[i] - first, sum(map(sum, pools[:i]))
            if below + (sum(pools[i]) if below < gap else 0) < gap:
                pools[i].append(first)
                break
            windows.append((tiers[i], [first, *(fill(gap, i - 1 if below >= gap else i) if gap else [])]))
    return windows, sorted(n for p in pools for n in p)


@pytest.mark.parametrize("seed", range(60))
def test_pack_against_plain_lists(seed):
    rng = random.Random(seed)
    tiers = rng.choice([P.TIERS, (4, 8, 16), (7, 50)])
    lengths = [rng.randint(0, rng.choice([3, tiers[0], tiers[-1], 3 * tiers[-1]])) for _ in range(rng.randint(0, 80))]
    windows, left = P.pack(lengths, [], tiers)
    assert ([(size, [n for _, _, n in pieces]) for size, pieces in windows], sorted(n for _, _, n in left)) == slow_pack(lengths, tiers)


@pytest.mark.parametrize("seed", range(40))
def test_pack(seed):
    rng = random.Random(seed)
    lengths = [int(10 ** rng.uniform(0, rng.choice([2, 3, 4]))) for _ in range(rng.randint(0, 120))]
    windows, left = P.pack(lengths, [])
    assert all(sum(n for _, _, n in pieces) == size and size in P.TIERS for size, pieces in windows)
    assert sum(n for _, _, n in left) < P.TIERS[-1]
    parts = {}
    for d, s, n in [*left, *(p for _, pieces in windows for p in pieces)]:
        parts.setdefault(d, []).append((s, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, m in sorted(parts[d]):
            assert s == at
            at += m
        assert at == n


def test_buffers_carry_over(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    rows = P.pack_documents(docs.coalesce(1), PATH, buffer_tokens=3000, with_ids=True).collect()
    rest, padding, _ = whole(rows, ids)
    assert not rest and padding < 2048
    assert all(r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tolist() for r in rows)


HARD = ["Hello WORLD's it'll <|endoftext|> x", "<|ENDOFTEXT|>a<|startoftext|>b", "ΑΣ ΟΔΟΣ Σ", "été x\xa0y　z\x1ca\x0bb\x85c", "don't 'sss ''ll 12345 a1b2 ß ÿ × ÷ İ ﬁ ſ K", "", "   ", "日本語 テスト ① ² ½", "à̀́b", "😀👍🏽 ok", "a__b--c..'s'd", "é ́x", "\x00a\x07b"]


def test_tokens_are_exact(spark, tokenizer):
    texts = HARD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for cached in (5, 100_000):
        assert [x.tolist() for x in Words(PATH, cached).encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_edges(spark, tokenizer):
    docs = edge_documents(spark)
    rows = P.pack_documents(docs, PATH).collect()
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect() if r["doc_id"] not in (4,)}
    rest, _, total = whole(rows, ids)
    assert set(rest) == {4} and len([r for r in rest[4] if r["start"] == 0]) == 3
    assert P.pack_documents(docs.limit(0), PATH).count() == 0
