import random

import numpy as np
import pytest
from llm_cases import documents, edge_documents
from test_simhash_dedup import groups
from vecloom.llm import near_copies as N, simhash_dedup


def sets(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(x, y):
    both = len(x & y)
    return (both >= 0.8 * (len(x) + len(y) - both) - 1e-9) if x or y else True


def brute(docs):
    """docs: texts by id. The smallest id of each one's group."""
    ids = sorted(docs)
    s = {i: sets(docs[i]) for i in ids}
    return groups([(a, b) for n, a in enumerate(ids) for b in ids[:n] if alike(s[a], s[b])], ids)


def kept(spark, docs, **how):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    return {r["doc_id"] for r in N.keep_first(df, **how).collect()}


def test_documents(spark, sf):
    docs = documents(spark, sf)
    assert kept(spark, docs) == {i for i, g in brute(docs).items() if i == g}


@pytest.mark.parametrize("how", [{}, {"chunk": 5, "family": 4}, {"chunk": 5, "family": 4, "across": 3, "crowd": 3}])
def test_planted_copies(spark, how):
    """Copies with one word in forty replaced are found, texts with one in eight are left alone, in groups larger than a chunk as well."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def changed(w, share):
        w = list(w)
        for i in rng.sample(range(len(w)), max(1, int(len(w) * share))):
            w[i] = rng.choice(vocabulary)
        return w

    docs, near, other = {}, [], []
    for g in range(30):
        base = text(rng.randint(120, 400))
        docs[len(docs)] = base
        for _ in range(25 if g == 0 else 2):
            near.append(len(docs))
            docs[len(docs)] = changed(base, 0.01)
        other.append(len(docs))
        docs[len(docs)] = changed(base, 0.13)
    got = kept(spark, {i: " ".join(w) for i, w in docs.items()}, **how)
    assert set(other) <= got
    assert sum(i in got for i in near) <= 0.02 * len(near)


def test_groups_across_chunks(spark):
    """A chain in which only neighbours are alike, among texts that share most of their words with all: chunks of two must not part it."""
    rng = random.Random(11)
    fresh = iter(range(10**6))
    shared = [f"s{next(fresh)}" for _ in range(500)]
    docs, chain = {}, list(shared)
    for _ in range(24):
        docs[len(docs)] = " ".join(chain)
        at = rng.randrange(0, 480, 10)
        chain = chain[:at] + [f"c{next(fresh)}" for _ in range(40)] + chain[at + 40 :]
    for _ in range(12):
        w = list(shared)
        for i in range(0, 500, 12):
            w[i] = f"x{next(fresh)}"
        docs[len(docs)] = " ".join(w)
    want = brute(docs)
    assert len(set(want.values())) > 10 and max(want.values()) > 23 and sum(g == 0 for g in want.values()) > 5
    for how in ({"chunk": 1000, "family": 2, "across": 3, "crowd": 4}, {"family": 5}, {}):
        assert kept(spark, docs, **how) == {i for i, g in want.items() if i == g}, how


def test_the_keys_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    often = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    n = rng.integers(3, 9000, 400)
    for _ in range(300):
        size, hot = int(rng.integers(1, 400)), float(rng.choice([0.0, 0.3, 0.9]))
        pick = lambda k: np.where(rng.random(k) < hot, rng.choice(often, k), rng.integers(0, 2**63, k).astype(np.uint64))
        base = np.unique(pick(size))
        lost = int(len(base) * rng.uniform(0, 0.2))
        other = np.unique(np.concatenate([rng.permutation(base)[lost:], pick(int(len(base) * 0.05))]))
        both = len(np.intersect1d(base, other))
        if both >= 0.8 * (len(base) + len(other) - both):
            a, b = (set(np.concatenate(N.keys(x, often, n)).tolist()) for x in (base, other))
            assert a & b
            assert len(a) <= len(base) // 5 + 1


def test_comparison_in_a_family():
    rng = np.random.default_rng(0)
    sets_ = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(60)]
    f = rng.integers(0, 1 << 16, (60, 2)).astype(np.uint64)  # within 32 bits of each other
    size = lambda a, b: len(np.intersect1d(sets_[a], sets_[b]))
    want = [(a, b) for a in range(60) for b in range(a) if size(a, b) >= 0.5 * (len(sets_[a]) + len(sets_[b]) - size(a, b))]
    got = N.similar(np.zeros(60, int), f, sets_, 0.5)
    assert groups(got, range(60)) == groups(want, range(60)) and len(got) < 60
    own = np.arange(60) % 2
    across = N.similar(own, f, sets_, 0.5)
    assert groups(across, range(60)) == groups([(a, b) for a, b in want if own[a] != own[b]], range(60))


def test_edits_at_the_threshold(spark):
    """Blocks put in, cut out or replaced at a similarity just above 0.8: not one pair is missed, and none below is taken."""
    rng = random.Random(9)
    weights = [1 / (i + 1) for i in range(5000)]
    text = lambda n: [f"w{i}" for i in rng.choices(range(5000), weights, k=n)]
    docs = {}
    for g in range(600):
        w = text(rng.randint(60, 400))
        n, at = len(w), rng.randrange(len(w))
        share = rng.uniform(0.13, 0.20) if g % 3 < 2 else rng.uniform(0.06, 0.11)
        k = int(n * share)
        other = (w[:at] + text(k) + w[at:], w[: n - k], w[: at // 2] + text(k) + w[at // 2 + k :])[g % 3]
        docs[2 * g], docs[2 * g + 1] = " ".join(w), " ".join(other)
    s = {i: sets(x) for i, x in docs.items()}
    close = [i for i in range(0, 1200, 2) if alike(s[i], s[i + 1])]
    assert 250 < len(close) < 600
    assert kept(spark, docs) == set(docs) - {i + 1 for i in close}


def test_repeats_do_not_part_copies(spark):
    """Shingles count once, however often a copy repeats a line."""
    rng = random.Random(8)
    docs = {}
    for _ in range(20):
        base, line = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (400, 8))
        docs[len(docs)] = " ".join(base + line * 2)
        docs[len(docs)] = " ".join(base + line * 20)
    assert kept(spark, docs) == {i for i, g in brute(docs).items() if i == g} == set(range(0, 40, 2))


def test_far_fingerprints_in_a_family():
    sets_ = [np.arange(100, dtype=np.uint64), np.arange(5, 100, dtype=np.uint64), np.arange(50, 150, dtype=np.uint64)]
    f = np.array([[0, 0], [2**64 - 1, 2**64 - 1], [0, 0]], np.uint64)
    assert N.similar(np.zeros(3, int), f, sets_, 0.8) == [(0, 1)]


def test_edges(spark):
    docs = edge_documents(spark)
    left = N.keep_first(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in left.collect()) == [-1, 1, 3, 4, 4, 6]
    assert N.keep_first(docs.limit(0)).count() == 0


def test_similarity_mode_links_by_golay_keys(spark, monkeypatch):
    """Without candidates of shared shingles, operator 6's own fingerprints, keys and links find light edits; sets decide on them too."""
    rng = random.Random(4)
    rows = []
    for i in range(0, 60, 3):
        w = [rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 999)) for _ in range(900)]
        edited = [*w, "end"]
        rows += [(i, " ".join(w)), (i + 1, " ".join(edited)), (i + 2, " ".join(reversed(w)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {i for i in range(0, 60, 3) if (simhash_dedup.fingerprint(rows[i][1]) ^ simhash_dedup.fingerprint(rows[i + 1][1])).bit_count() <= 2}
    assert len(near) > 10
    monkeypatch.setattr(N, "links", lambda first, similarity: spark.createDataFrame([], "a long, b long"))
    kept = {r["doc_id"] for r in simhash_dedup.keep_similar(docs).collect()}
    assert kept == {i for i, _ in rows} - {i + 1 for i in near}
