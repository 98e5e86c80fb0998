import hashlib
import random
import re

import numpy as np
import pytest
from llm_cases import LONG, edge_documents
from vecloom.llm import suffix_decontam as S

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(docs, items):
    win = {}
    for i, t in items:
        w = W.findall(low(t or ""))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            win.setdefault(n, {}).setdefault(tuple(w[j : j + n]), set()).add(str("" if i is None else i))
    out = []
    for d, t in docs:
        w, hit, its = W.findall(low(t or "")), set(), set()
        for n, by in win.items():
            for j in range(len(w) - n + 1):
                if found := by.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    its |= found
        out.append((d, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def found(docs, items, **how):
    return sorted((tuple(r)[:6] for r in S.report(docs, items, **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"block_bytes": 3000}, {"block_bytes": 500, "pass_blocks": 2}])
def test_query(spark, sf, how):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    more = spark.createDataFrame([(900, "of"), (901, "the OF"), (902, "..."), (903, None), (None, "a b c d e f g h i j k l")], items.schema)
    for x in (items, items.union(more)):
        want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in x.collect()])
        assert found(docs, x, **how) == want


def test_random_texts(spark):
    rng = random.Random(0)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, text(rng.randint(0, 200))) for i in range(60)]
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 14]))) for i in range(30)]
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items[8:], "item_id int, text string")
    assert found(d, b) == brute(docs, items[8:])
    assert found(d, b, block_bytes=20) == brute(docs, items[8:])


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(40))
    doc = "x y " + " ".join(f"w{i}" for i in range(5, 33)) + " z " + " ".join(f"w{i}" for i in range(12))
    d, b = spark.createDataFrame([(1, doc)], "doc_id int, text string"), spark.createDataFrame([(7, item), (8, "other words here")], "item_id int, text string")
    r = S.report(d, b).head()
    assert (r["longest_match"], r["match_word"], r["match_item"], r["match_item_word"], r["n_hit"]) == (28, 2, "7", 5, 40)


def test_longest_match_against_all_places():
    rng = random.Random(4)
    items = [(str(i), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.choice([1, 9, 30, 90]))]) for i in range(12)]
    docs = [[rng.choice([b"a", b"b", b"c", b"x"]) for _ in range(300)] for _ in range(3)] + [items[-1][1] * 2, items[3][1]]
    index = S.Index(list(items))
    x = np.array([t for w in docs for t in (*(index.vocabulary.get(v, 0) for v in w), 0)], np.int32)
    n, where = index.longest(x, np.arange(len(x)))
    tokens = index.tokens.tolist()

    def common(a, b):
        k = 0
        while a + k < len(x) and b + k < len(tokens) and x[a + k] == tokens[b + k] != 0:
            k += 1
        return k

    for a in range(len(x)):
        assert n[a] == max(common(a, b) for b in range(len(tokens)))
        assert common(a, where[a]) == n[a]


def test_a_long_item_quoted_whole(spark):
    """Memory and time stay in proportion to an item's words."""
    import tracemalloc

    rng = random.Random(6)
    words = [f"w{rng.randrange(30000)}" for _ in range(50_000)]
    index = S.Index([("long", [w.encode() for w in words])])
    docs = [[w.encode() for w in ["before", *words, "behind"]], [w.encode() for w in words[100:60:-1]]]
    tracemalloc.start()
    out = index.scan(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[1] is None and out[0]["hits"] == [(1, 50_001)] and out[0]["longest"] == (50_000, 1, "long", 0)
    assert peak < 150 << 20
    d, b = spark.createDataFrame([(1, "x " + " ".join(words))], "doc_id int, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id int, text string")
    r = S.report(d, b).head()
    assert (r["n_hit"], r["longest_match"], r["match_word"]) == (50_000, 50_000, 1)


def test_suffix_array():
    rng = np.random.default_rng(0)
    x = np.append(rng.integers(0, 3, 300), 0).astype(np.int32)
    sa = S.suffix_array(x, 12)
    keys = [tuple(x[i : i + 12]) for i in sa]
    assert keys == sorted(keys) and sorted(sa.tolist()) == np.nonzero(x)[0].tolist()


def test_edges(spark):
    docs = edge_documents(spark)
    items = spark.createDataFrame([(1, "twice the same row"), (2, LONG[:200]), (3, None)], "item_id long, text string")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, items) == brute(rows, [tuple(r) for r in items.collect()])
    left = S.remove(docs, items)
    assert left.columns == docs.columns and left.count() == 6
    assert S.remove(docs, items.limit(0)).count() == docs.count()
    assert found(docs.limit(0), items) == []
