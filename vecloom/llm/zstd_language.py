"""Language identification by compression with per-language zstandard dictionaries.

Learning: distinct labelled texts are counted by language, all languages, and of each, texts with the smallest hashes are drawn
until their letters fill a raw-content dictionary: at most SAMPLE_DOCS texts and DICT_BYTES, or an even share of TOTAL_BYTES,
LEAST_BYTES at least, where languages are many. A text longer than TEXT_MOST characters lends that many, from a place that
its hash tells. The sample depends on text and language only. It is the classifier's only limit and doesn't grow with the
corpus; what is sent to the executors grows with the number of languages beyond TOTAL_BYTES / LEAST_BYTES only.

Case, digits and signs are left out first: texts and samples are their lowered letters, words parted by one space.

Prediction: all of a text is compressed with each language's dictionary, in pieces of PIECE_BYTES, as zstandard drops a
dictionary once the input has run past the window. The language of the smallest sum of sizes is chosen.
The result is rejected (`rejected`, the choice stays visible) where the runner-up is nearly as small: by less than
MARGIN_BYTES or MARGIN_SHARE of it. `score` is the softmax of the negative sizes in units of SCALE_BYTES.

Defined cases: a null text, or one without a letter, is `und` with score 0 and rejected; very long texts are compressed whole;
of equal sizes the language that is commoner among the learned texts wins; repeated rows get equal results, and count once in
learning; without any labelled text all are `und`; an empty table gives an empty result; languages are learned as they are
written, the empty string included; ids take no part; other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from vecloom.llm.common import append, appended, at, named, texts

SAMPLE_DOCS, DICT_BYTES, TOTAL_BYTES, LEAST_BYTES, TEXT_MOST = 256, 256 << 10, 16 << 20, 4 << 10, 8000
MARGIN_BYTES, MARGIN_SHARE, SCALE_BYTES = 3, 0.005, 4.0
#: Well under the window.
PIECE_BYTES = 64 << 10
UNDETERMINED = "und"
#: Short matches tell languages apart, so they count from four bytes on.
PARAMETERS = {"window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 5, "min_match": 4, "strategy": zstandard.STRATEGY_GREEDY, "write_content_size": 0}
NO_LETTERS = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")


def letters(text: str) -> bytes:
    return NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], int, DataFrame]:
    """The languages, the commonest first; the bytes of a dictionary; and a table of lang, h and t to make them from, of some 3 x SAMPLE_DOCS rows of TEXT_MOST characters a language."""
    t, h = at(text_col).cast("string"), F.col("h")
    rows = labelled.select(at(lang_col).cast("string").alias("lang"), t.alias("t"), F.xxhash64(t).alias("h")).where("lang is not null and t is not null")
    # One row for each language. Copies count once, so that they don't crowd out the sample.
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.avg(F.least(F.char_length("t"), F.lit(TEXT_MOST))).alias("chars")).orderBy(F.desc("n"), "lang").collect()
    most = max(LEAST_BYTES, min(DICT_BYTES, TOTAL_BYTES // max(1, len(counts))))
    span = 1 << 62
    # Three times as many texts as needed pass by their hash, where so many are there, so that chance leaves enough.
    wanted = [(r["lang"], min(span, int(span * 3 * min(SAMPLE_DOCS, most / max(1.0, r["chars"]) + 16) / max(1, r["n"])) + 1)) for r in counts]
    least = F.broadcast(rows.sparkSession.createDataFrame(wanted, "lang string, below long"))
    place = F.when(F.char_length("t") > TEXT_MOST, F.pmod(F.shiftright(h, 7), F.char_length("t") - TEXT_MOST + 1)).otherwise(0).cast("int")
    drawn = rows.join(least, "lang").where(F.shiftrightunsigned(h, 2) < F.col("below"))
    return [r["lang"] for r in counts], most, drawn.select("lang", F.shiftrightunsigned(h, 2).alias("h"), F.substring(F.col("t"), place + 1, F.lit(TEXT_MOST)).alias("t")).distinct()


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary for each language, the commonest first."""
    langs, most, drawn = sample(labelled, text_col, lang_col)
    found: dict[str, list[tuple[int, str]]] = {}
    for lang, h, t in drawn.collect():
        found.setdefault(lang, []).append((h, t))
    out = {}
    for lang in langs:
        raw, size = [], 0
        for _, t in sorted(found.get(lang, []))[:SAMPLE_DOCS]:
            raw.append(letters(t))
            size += len(raw[-1])
            if size >= most:
                break
        out[lang] = b"\n".join(reversed(raw))[-most:]
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.by = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(**PARAMETERS)
            d.precompute_compress(compression_params=how)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, its score, and whether the margin is too narrow."""
        if not text or not self.by or not LETTER.search(text):
            return UNDETERMINED, 0.0, True
        raw = letters(text)
        pieces = [raw[a : a + PIECE_BYTES] for a in range(0, len(raw), PIECE_BYTES)]
        sizes = [sum(len(c.compress(x)) for x in pieces) for c in self.by]
        least = min(sizes)
        best = sizes.index(least)
        margin = min((s - least for i, s in enumerate(sizes) if i != best), default=len(raw))
        return self.langs[best], 1 / sum(exp(max(-700.0, (least - s) / SCALE_BYTES)) for s in sizes), margin < max(MARGIN_BYTES, MARGIN_SHARE * least)


def classify(docs: DataFrame, dictionaries: dict[str, bytes], carry: list[str], text_col: str = "text") -> DataFrame:
    """The carried columns, lang_pred, score and rejected."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(dictionaries)
    slim = docs.select(*(at(c).alias(f"c{i}") for i, c in enumerate(carry)), at(text_col).cast("string").alias("t"))
    added = "lang_pred string, score double, rejected boolean"
    ready: list[Classifier] = []

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ready:
            ready.append(Classifier(sent.value))
        for part, values in texts(batches, "t"):
            rows = [ready[0].predict(x) for x in values]
            columns = (pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))
            yield append(part.drop_columns(["t"]), **dict(zip(("lang_pred", "score", "rejected"), columns)))

    out = slim.mapInArrow(kernel, appended(T.StructType([f for f in slim.schema if f.name != "t"]), added))
    return named(out, carry, "lang_pred", "score", "rejected")
