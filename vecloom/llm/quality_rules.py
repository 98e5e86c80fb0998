"""Weak supervision of text quality: rules vote or abstain, EM learns how far to trust each, a posterior decides.

1. One pass over whole texts gives counts and from them a vote of every rule: 1 good, -1 bad, 0 abstains.
2. The votes of a document form a pattern. There are 3**R patterns at most (R rules), so a pre-aggregated count by
   pattern is a bounded table, whatever the corpus; EM on it equals EM over all documents.
3. EM (two classes, votes independent given the class, a full vote table for each rule and class, PRIOR_VOTES as
   pseudo-documents) starts from the share of good votes. It counts documents that pass the base rules: the others are
   decided, and their many agreeing votes on repetition would otherwise become the class that EM finds. The posterior
   of each pattern goes back to all documents. keep_good() counts twice rather than write the corpus once more.

Defined cases: a null or empty text has no words, fails the base rules and gets a posterior like any other; very long texts
are counted whole; a posterior of just POSTERIOR_LEAST is kept; repeated rows count as often as they occur; an empty table
gives an empty result; other columns may have any names, and are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from vecloom.llm.common import appended, at, materialize, named, numbered, texts

#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"
WORDS_LEAST, REPEAT_MOST = 50, 50
LETTER = re.compile(r"[^\W\d_]")

#: Each rule is (name, feature, good from, good to, bad below, bad above); between good and bad it abstains.
RULES = (
    ("length", "n_words", 80, float("inf"), 50, float("inf")),
    ("repeats", "repeat_share", 0, 0.10, -1, 0.30),
    ("symbols", "symbol_rate", 0, 0.03, -1, 0.15),
    ("dup_lines", "dup_line_share", 0, 0.05, -1, 0.25),
    ("word_length", "mean_word", 3, 10, 2.5, 14),
    ("letters", "letter_share", 0.93, 1, 0.78, 1),
    ("sentence_ends", "end_rate", 0.02, 0.5, 0.004, 1),
    ("variety", "distinct_share", 0.35, float("inf"), 0.15, float("inf")),
)
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_ends", "n_distinct"]
POSTERIOR_LEAST = 0.5
#: Pseudo-documents of each class, and how they vote bad, abstain, good.
PRIOR_DOCS = 20.0
PRIOR_VOTES = np.array([[0.5, 0.3, 0.2], [0.05, 0.15, 0.8]])


def repeated(words: list) -> int:
    """Words that lie in a window of three that occurs twice or more, its first occurrence included."""
    if len(words) < 4:
        return 0
    grams = list(zip(words, islice(words, 1, None), islice(words, 2, None)))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    covered, total = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


def count(text: str) -> list[int]:
    """The FEATURES of a text. Words are runs without ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    word_chars = len(text) - sum(map(text.count, SPACE))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        len(words),
        word_chars,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
        len(LETTER.findall(text)),
        sum(w[-1:] in (b".", b"!", b"?") for w in words),
        len(set(words)),
    ]


def votes(n: np.ndarray) -> np.ndarray:
    """n: rows of FEATURES. One column of votes for each rule; all rules abstain on a text without words."""
    c = {name: n[:, i].astype(float) for i, name in enumerate(FEATURES)}
    words = np.maximum(c["n_words"], 1)
    c |= {
        "repeat_share": c["n_repeat_words"] / words,
        "symbol_rate": c["n_symbols"] / words,
        "dup_line_share": c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        "mean_word": c["word_chars"] / words,
        "letter_share": c["n_letters"] / np.maximum(c["word_chars"], 1),
        "end_rate": c["n_ends"] / words,
        "distinct_share": c["n_distinct"] / np.sqrt(words * np.minimum(words, 400)),
    }
    out = np.zeros((len(n), len(RULES)), np.int8)
    for j, (_, feature, good, to, below, above) in enumerate(RULES):
        x = c[feature]
        out[(x >= good) & (x <= to), j] = 1
        out[(x < below) | (x > above), j] = -1
    out[(n[:, 0] == 0)] = 0
    return out


def fit(patterns: np.ndarray, weights: np.ndarray, prior_docs: float = PRIOR_DOCS, rounds: int = 200, tol: float = 1e-9) -> dict:
    """EM over distinct vote patterns with their counts. Gives the share of good documents, P(vote | class) by rule and the patterns' posteriors."""
    n, rules = patterns.shape
    if not n:
        return {"prior": 0.5, "table": np.full((2, rules, 3), 1 / 3), "posterior": np.zeros(0)}
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    good, bad = (patterns == 1).sum(1), (patterns == -1).sum(1)
    posterior = (good + 0.5) / (good + bad + 1.0)
    for _ in range(rounds):
        w = np.stack([weights * (1 - posterior), weights * posterior])
        table = np.einsum("cn,nrv->crv", w, onehot) + prior_docs * PRIOR_VOTES[:, None, :]
        table /= table.sum(2, keepdims=True)
        prior = (w[1].sum() + prior_docs) / (weights.sum() + 2 * prior_docs)
        log = np.einsum("nrv,crv->cn", onehot, np.log(table)) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done = np.abs(new - posterior).max() < tol
        posterior = new
        if done:
            break
    return {"prior": prior, "table": table, "posterior": posterior}


POWERS = 3 ** np.arange(len(RULES), dtype=np.int64)


def _counted(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the FEATURES, the votes as one number, and whether the base rules fail."""
    n = np.array([count(x) for x in values], np.int64).reshape(-1, len(FEATURES))
    words_, repeats = n[:, 0], n[:, FEATURES.index("n_repeat_words")]
    return n, (votes(n) + 1).astype(np.int64) @ POWERS, (words_ < WORDS_LEAST) | (100 * repeats > REPEAT_MOST * words_)


def features(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """carry (all columns by default) as a struct `row`, the counts as an array `n`, the votes as one number `pattern`, and base_failed."""
    keep = docs.columns if carry is None else carry
    row = F.struct(*(at(c) for c in keep)).alias("row") if keep else F.struct(F.lit(None).cast("int").alias("none")).alias("row")
    slim = docs.select(row, at(text_col).cast("string").alias("t"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in texts(batches, "t"):
            n, pattern, failed = _counted(values)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(list(n), pa.list_(pa.int64())), pa.array(pattern), pa.array(failed)], ["row", "n", "pattern", "base_failed"])

    return slim.mapInArrow(kernel, appended(T.StructType([slim.schema["row"]]), "n array<long>, pattern long, base_failed boolean"))


def learn(patterns: DataFrame) -> dict[int, float]:
    """patterns: pattern and n, how many documents that pass the base rules have it; a row for each pattern or more. The posterior of each."""
    by = patterns.groupBy("pattern").agg(F.sum("n")).orderBy("pattern").collect()  # 3**R rows at most
    codes, weights = np.array([r[0] for r in by], np.int64), np.array([r[1] for r in by], float)
    ballots = (codes[:, None] // POWERS % 3 - 1).astype(np.int8).reshape(-1, len(RULES))
    return dict(zip(codes.tolist(), fit(ballots, weights)["posterior"].tolist(), strict=True))


def apply_rules(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, posterior_least: float = POSTERIOR_LEAST) -> DataFrame:
    """row (struct of the carried columns, which are written once), the base counts, base_failed, posterior and kept."""
    spark = docs.sparkSession
    found = materialize(features(docs, text_col, carry), "quality")
    model = learn(found.select("pattern", F.when(F.col("base_failed"), 0).otherwise(1).alias("n")))
    learned = spark.createDataFrame(list(model.items()), "pattern long, posterior double")
    n = [F.col("n")[i].alias(name) for i, name in enumerate(FEATURES[:5])]
    return found.join(F.broadcast(learned), "pattern", "left").select("row", *n, "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= posterior_least)).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", posterior_least: float = POSTERIOR_LEAST) -> DataFrame:
    """The documents that are kept, with their own columns."""
    slim, t = numbered(docs, text_col)

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for _, values in texts(batches, t):
            _, pattern, failed = _counted(values)
            total.update(dict.fromkeys(pattern.tolist(), 0))
            total.update(pattern[~failed].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["pattern", "n"])

    model = learn(slim.select(t).mapInArrow(counting, "pattern long, n long"))

    def keeping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in texts(batches, t):
            _, pattern, failed = _counted(values)
            posterior = np.array([model[p] for p in pattern.tolist()], float)
            yield part.filter(pa.array(~failed & (posterior >= posterior_least)))

    return named(slim.mapInArrow(keeping, slim.schema), docs.columns)
