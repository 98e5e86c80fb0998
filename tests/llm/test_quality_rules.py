import math
import re
from collections import Counter

import numpy as np
from llm_cases import documents, edge_documents
from vecloom.llm import quality_rules as Q
from vecloom.llm.queries import op10_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def plain_votes(text):
    """A document's votes, rule by rule."""
    n_words, chars, symbols, dup_lines, repeats = brute(text)
    words = WORD.findall(text)
    if not words:
        return [0] * len(Q.RULES)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    value = {
        "n_words": n_words,
        "repeat_share": repeats / n_words,
        "symbol_rate": symbols / n_words,
        "dup_line_share": dup_lines / len(lines),
        "mean_word": chars / n_words,
        "letter_share": sum(c.isalpha() or bool(re.match(r"[^\W\d_]", c)) for c in text) / chars,
        "end_rate": sum(w[-1] in ".!?" for w in words) / n_words,
        "distinct_share": len(set(words)) / (n_words * min(n_words, 400)) ** 0.5,
    }
    return [-1 if (x := value[feature]) < below or x > above else 1 if good <= x <= to else 0 for _, feature, good, to, below, above in Q.RULES]


def plain_em(votes, counted):
    """The posterior of each document, by EM over documents; only the counted ones teach."""
    p = [(v.count(1) + 0.5) / (v.count(1) + v.count(-1) + 1) for v in votes]
    for _ in range(200):
        table = [[[Q.PRIOR_DOCS * Q.PRIOR_VOTES[c][v] for v in range(3)] for _ in Q.RULES] for c in range(2)]
        good = total = 0.0
        for x, v, use in zip(p, votes, counted):
            if use:
                good, total = good + x, total + 1
                for r, vote in enumerate(v):
                    table[0][r][vote + 1] += 1 - x
                    table[1][r][vote + 1] += x
        prior = (good + Q.PRIOR_DOCS) / (total + 2 * Q.PRIOR_DOCS)
        share = [[[math.log(x / sum(row)) for x in row] for row in of] for of in table]
        new = []
        for v in votes:
            bad, fine = (math.log(a) + sum(share[c][r][vote + 1] for r, vote in enumerate(v)) for c, a in ((0, 1 - prior), (1, prior)))
            new.append(1 / (1 + math.exp(max(-500, min(500, bad - fine)))))
        if max(abs(a - b) for a, b in zip(p, new)) < 1e-9:
            return new
        p = new
    return p


def plain_kept(docs):
    """docs: texts by id. The ids that are kept."""
    order = sorted(docs)
    n = {i: brute(docs[i]) for i in order}
    passed = [n[i][0] >= 50 and 100 * n[i][4] <= 50 * n[i][0] for i in order]
    posterior = plain_em([plain_votes(docs[i]) for i in order], passed)
    return {i for i, ok, p in zip(order, passed, posterior) if ok and p >= Q.POSTERIOR_LEAST}


def test_against_plain_em(spark, sf):
    docs = documents(spark, sf)
    assert {r["doc_id"] for r in op10_quality_rules(spark, sf).where("kept").collect()} == plain_kept(docs)
    assert {r["doc_id"] for r in Q.keep_good(spark.read.parquet(f"{sf}/documents.parquet")).collect()} == plain_kept(docs)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op10_quality_rules(spark, sf).collect()}
    docs = documents(spark, sf)
    assert set(rows) == set(docs)
    for i, text in docs.items():
        r, want = rows[i], brute(text)
        assert tuple(r[c] for c in Q.FEATURES[:5]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    # The posterior is that of EM over every document's votes.
    order = sorted(docs)
    votes = Q.votes(np.array([Q.count(docs[i]) for i in order]))
    passed = np.array([not rows[i]["base_failed"] for i in order])
    model = Q.fit(votes, passed.astype(float))
    assert np.allclose(model["posterior"], [rows[i]["posterior"] for i in order], atol=1e-6)
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [r["doc_id"] for r in labels if r["quality"] == 1 and not rows[r["doc_id"]]["base_failed"]]
    bad = [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(rows[i]["kept"] for i in good) >= 0.98 * len(good)
    assert sum(rows[i]["kept"] for i in bad) <= 0.05 * len(bad)


def test_counts():
    for text in ["", "a", "a b c a b c", "a a a a a", "x\n\nx\n \nx y\r\nx y\r", "é# | * b\x1cc\n", "a b\n" * 30, "one two three four " * 20]:
        assert tuple(Q.count(text)[:5]) == brute(text), text


def test_em_tells_two_kinds_apart():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    votes = np.stack([np.where(rng.random(4000) < 0.9, 1, rng.choice([-1, 0], 4000)) * np.where(good, 1, -1) for _ in range(len(Q.RULES))], 1)
    p = Q.fit(votes, np.ones(4000))
    assert ((p["posterior"] > 0.5) == good).mean() > 0.99 and abs(p["prior"] - 0.8) < 0.03
    assert Q.fit(votes[:0], np.ones(0))["posterior"].shape == (0,)


def test_edges(spark):
    docs = edge_documents(spark)
    out = Q.apply_rules(docs)
    assert out.count() == docs.count() and out.where("posterior IS NULL OR kept IS NULL").count() == 0
    assert {r["base_failed"] for r in out.where("row.text IS NULL").collect()} == {True}
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert Q.keep_good(docs.limit(0)).count() == 0
