"""SimHash fingerprints and Golay-code fuzzy hashing: all links of at most two bits, by equality joins.

The binary Golay code has 4096 words of 23 bits, and every 23-bit vector lies within three bits of exactly one.
The keys of a vector are the indices of the words to which it and its 23 one-bit neighbours decode: one key, or six
when it lies three bits off its word. Two vectors at most two bits apart have a vector within one bit of both, so
they share a key.

A 64-bit fingerprint is cut into three segments. Of two differing bits at least one segment has none, so each table t
takes segment t exactly and the Golay keys of the 23 bits behind it: about 16 keys of 36 bits for a fingerprint, and
every pair at most two bits apart meets in some key.

Keys are counted first. Keys of one fingerprint go; in keys of up to `bucket` fingerprints members are verified against
each other, leaving a spanning forest of true links. Fuller keys are never enumerated: each of their fingerprints goes
to the 65 points within one bit of it, and fingerprints at one point (65 at most, by geometry) are at most two bits
apart. That way is exact too, and linear.

Fingerprints of many documents, of which there can be few, get their component by a bounded broadcast, the others by a join.

Defined cases: a null text is empty; a text without words has fingerprint zero and links like any other; very long texts count
whole; repeated rows share a fingerprint; rows without an id take part but never name a component while others do; an
empty table gives an empty result; other columns are ignored by dedup() and kept by keep_first(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from vecloom.llm import near_copies
from vecloom.llm.common import at, materialize, texts
from vecloom.llm.components import components, spanning

SEED, SHINGLE, BUCKET = 42, 3, 16
#: Rows that make a fingerprint hot, and hot ones that are broadcast at most: those of the most rows.
HOT_ROWS, HOT = 1000, 10_000
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
#: First bit and length of each exact segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Words are runs without ASCII white space, A-Z lowered; fewer than `shingle` words are one shingle; none give 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        j = min(n, i + (1 << 16))
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[i:j].tolist(), ends[i + shingle - 1 : j + shingle - 1].tolist())), "<u8", j - i)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _golay() -> tuple[np.ndarray, list[np.ndarray]]:
    """The syndromes of all 23-bit vectors' upper and lower halves, and for each syndrome how its keys differ from the vector's upper 12 bits."""
    unit = []
    for i in range(23):
        r = 1 << i
        for j in range(22, 10, -1):
            if r >> j & 1:
                r ^= GENERATOR << (j - 11)
        unit.append(r)
    error = np.zeros(2048, np.int64)
    for a in range(-1, 23):
        for b in range(a if a < 0 else a + 1, 23):
            for c in range(b if b < 0 else b + 1, 23):
                bits = [x for x in (a, b, c) if x >= 0]
                s = 0
                for x in bits:
                    s ^= unit[x]
                error[s] = sum(1 << x for x in bits)
    half = np.zeros((2, 4096), np.int64)
    for i in range(23):
        side, bit = (0, i) if i < 12 else (1, i - 12)
        half[side] ^= np.where(np.arange(4096) >> bit & 1, unit[i], 0)
    deltas = []
    for s in range(2048):
        reach = {int(error[s]) >> 11} | {((1 << i) ^ int(error[s ^ unit[i]])) >> 11 for i in range(23)}
        deltas.append(np.array(sorted(reach), np.int64))
    return half, deltas


_HALF, _DELTAS = _golay()
_WIDTH = np.array([len(d) for d in _DELTAS])
_TABLE = np.stack([np.resize(d, 6) for d in _DELTAS])  # repeated to six


def golay_keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """v: 23-bit vectors. Six keys each, and how many of them are distinct (the first ones)."""
    s = _HALF[0][v & 4095] ^ _HALF[1][v >> 12]
    return (v >> 11)[:, None] ^ _TABLE[s], _WIDTH[s]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """fp: uint64 fingerprints. (index into fp, key) for all tables."""
    index, found = [], []
    for t, (first, length) in enumerate(SEGMENTS):
        turned = (fp >> np.uint64(first)) | (fp << np.uint64(64 - first)) if first else fp
        exact = (turned & np.uint64((1 << length) - 1)).astype(np.int64)
        g, n = golay_keys((turned >> np.uint64(length) & np.uint64((1 << 23) - 1)).astype(np.int64))
        use = np.arange(6) < n[:, None]
        index.append(np.nonzero(use)[0])
        found.append((np.int64(t) << 34 | exact[:, None] << 12 | g)[use])
    return np.concatenate(index), np.concatenate(found)


def fingerprints(docs: DataFrame, text_col: str, carry: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The carried columns as a struct `row`, and the fingerprint as a signed long `fp`."""
    slim = docs.select(F.struct(*(at(c) for c in carry)).alias("row"), at(text_col).cast("string").alias("t"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in texts(batches, "t"):
            fp = np.array([fingerprint(x, shingle) for x in values], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(fp)], ["row", "fp"])

    return slim.mapInArrow(kernel, T.StructType([slim.schema["row"], T.StructField("fp", T.LongType())]))


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        index, found = keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(fp[index])], ["key", "fp"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From small key groups, a spanning forest of their links."""
    for b in batches:
        out: set[tuple[int, int]] = set()
        for group in b.column(0).to_pylist():
            pairs = [(x, y) for i, x in enumerate(group) for y in group[:i] if ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 2]
            out.update(spanning(pairs))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)]).view(np.int64)
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ flips).ravel()), pa.array(np.repeat(fp, 65))], ["point", "fp"])


def links(distinct_fp: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """distinct_fp: a column fp without repeats. Links (a, b) of at most two bits that connect whatever is connected."""
    keyed = distinct_fp.mapInArrow(_with_keys, "key long, fp long")
    size = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(keyed.join(size, "key"), "keys")
    few = members.where(F.col("size") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("group"))
    few = few.select("group").mapInArrow(_verified, "a long, b long")
    full = members.where(F.col("size") > bucket).select("fp").distinct()
    near = full.mapInArrow(_points, "point long, fp long").groupBy("point").agg(F.array_sort(F.collect_set("fp")).alias("group")).where("size(group) > 1")
    star = near.select(F.col("group")[0].alias("a"), F.explode(F.slice("group", 2, 64)).alias("b"))
    return few.union(star).distinct()


def classes(found: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """found: columns fp and id, materialized. (fp, root, component_id, n) for every fingerprint of n rows; the id is the component's smallest."""
    first = materialize(found.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprints")
    linked = components(links(first.select("fp"), bucket))
    nodes = materialize(linked.union(linked.select("root", "root").distinct()), "nodes")
    named_ = nodes.join(first, nodes["node"] == first["fp"]).groupBy("root").agg(F.min("first").alias("least"))
    by_node = nodes.join(named_, "root").select(F.col("node").alias("fp"), "root", "least")
    # A null least is a component without any id, where first is null as well.
    return first.join(by_node, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id"), "n")


def classified(found: DataFrame, bucket: int = BUCKET, hot_rows: int = HOT_ROWS, hot: int = HOT) -> DataFrame:
    """found with root and component_id."""
    known = materialize(classes(found.select("fp", "id"), bucket), "classes")
    # HOT rows at most; all other fingerprints have so few rows that a join on them is even.
    common = F.broadcast(known.where(F.col("n") > hot_rows).orderBy(F.desc("n"), "fp").limit(hot).drop("n"))
    by_hot = found.join(common, "fp")
    rest = found.join(common.select("fp"), "fp", "left_anti").join(known.drop("n"), "fp")
    return by_hot.unionByName(rest)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """One row for each document: id_col, fingerprint (16 hex digits) and component_id."""
    found = materialize(fingerprints(docs, text_col, [id_col], shingle).select(F.col("row")[id_col].alias("id"), "fp"), "simhash")
    return classified(found, bucket).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """The documents with one row of each component left: that of the smallest id (of repeated rows, one)."""
    found = materialize(fingerprints(docs, text_col, docs.columns, shingle).withColumn("rid", F.monotonically_increasing_id()), "simhash-rows")
    slim = found.select("rid", "fp", F.col("row")[id_col].alias("id"))
    ranked = classified(slim, bucket).select("root", F.struct(F.col("id").isNull().alias("none"), "id", "rid").alias("o"))
    winners = ranked.groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.rid").alias("rid"))
    return found.join(winners, "rid", "left_semi").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = near_copies.SIMILARITY) -> DataFrame:
    """keep_first by similarity on five-word shingles instead of by two bits. Fingerprints, Golay keys and links are those of dedup(); texts at 0.8 lie farther apart, so near_copies adds candidates by shared shingles, and sets of shingles decide on all."""
    return near_copies.keep_first(docs, id_col, text_col, similarity, simhash=fingerprint, linked=links)
