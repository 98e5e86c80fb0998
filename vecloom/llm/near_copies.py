"""Near copies at a similarity of 0.8 or more on five-word shingles: keys from sets, SimHash to sift, exact sets to decide.

Fingerprints of texts at 0.8 differ in some 15 of 100 bits, beyond what a Golay code's keys reach, so the keys are shingles
themselves and wide fingerprints of FP_WORDS x 64 bits sift what meets.

Shingles have one order for all texts: rare ones first, by hash, then common ones, the less common first. COMMON of those
that are found in several texts of a block count as common at most. Of a set of n, at most u = n - ceil(s * n) shingles
are missing in a similar set. So among its first u + 1 at least one is shared (a prefix filter). Where rare shingles
are more than u, fewer do: of a shingles in random order the first k are all missing with a chance of at most (u / a)**k,
and k is chosen to make that MISS: 13 keys for a text of rare shingles, of whatever length.

1. Texts of equal words become one node, by their digest.
2. Each node gives its keys, and operator 6 the links of its own fingerprints (SimHash of 64 bits, Golay keys, two bits at
   most), which are candidates likewise. Nodes that share a key are linked if their sizes allow it and their fingerprints are within
   FAR bits, which similar sets miss by seven standard deviations. In crowds of one key that nobody knew to be common,
   windows of rows are compared and neighbouring windows are linked outright; a key known to be very common links its
   nodes outright, through a node of its own. Connected components of all these links are families.
3. In each family nodes are compared on their sets of shingles, unless they are linked already or can't be similar by their
   sizes or parities. Families of more than FAMILY nodes or CHUNK_BYTES are dealt into chunks: nodes are compared within
   chunks, then one node of each group found so far across chunks of ACROSS, and last, in families that are still not one
   group, those outside its largest group with all. So a large group of near copies is compared in a few passes, and no pair
   is left out. Connected components of the verified links are the groups.

Joins that fetch texts are sort-merge joins at any size: what they look up grows with the corpus.

Defined cases: as in simhash_dedup. A text of fewer than five words, but not none, is one shingle; texts without words
are equal to each other; very long texts have as many keys as others; columns may have any names; of repeated rows one stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vecloom.llm.common import append, appended, groups, materialize, named, numbered, owned, release, texts
from vecloom.llm.components import components, forest

SHINGLE, SIMILARITY = 5, 0.8
#: Shingles counted in one block of texts; texts of a block that make a shingle common; common shingles told apart.
BLOCK, SEVERAL, COMMON = 1 << 21, 3, 1 << 20
#: The chance that a pair of exactly the similarity shares no key, for each of its sides.
MISS = 1e-9
#: Common shingles of more texts than this link them outright.
CROWD = 4096
#: Rows of one key that are compared with each other at once.
WINDOW, SMALL = 1024, 32
#: Words of 64 bits in a fingerprint, and the bits that similar sets may differ in.
FP_WORDS, FAR = 4, 80
#: Pairs whose fingerprints differ in so few bits are compared first. It decides nothing.
NEAR_BITS = 32
PARITY_BITS = 1024
FAMILY, ACROSS, CHUNK_BYTES = 256, 2048, 16 << 20
MULTIPLIER = np.uint64(xxhash.xxh64_intdigest("shingle") | 1)
MIX = np.uint64(xxhash.xxh64_intdigest("mix") | 1)
SALTS = np.array([xxhash.xxh64_intdigest(f"salt {i}") for i in range(FP_WORDS)], np.uint64)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def hashes(w: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The set of shingles of these words, sorted."""
    if not w:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    size = min(size, len(w))
    n = len(w) - size + 1
    out = one[:n].copy()
    for i in range(1, size):
        out *= MULTIPLIER
        out += one[i : i + n]
    return np.unique(_mixed(out))


def fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash over a set of shingles."""
    total = np.zeros(64 * FP_WORDS, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = _mixed(h[i : i + (1 << 14), None] ^ SALTS)
        total += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(total * 2 > len(h), bitorder="little").view("<u8")


def common(slim: DataFrame, text_col: str, block: int = BLOCK, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a block hold, sorted, and in how many texts they were found."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held or [np.empty(0, np.uint64)]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[n >= SEVERAL].view(np.int64)), pa.array(n[n >= SEVERAL].astype(np.int64))], ["h", "n"])

        size = 0
        for _, values in texts(batches, text_col):
            for x in values:
                held.append(hashes(words(x)))
                size += len(held[-1])
                if size >= block:
                    yield counted()
                    size = 0
        yield counted()

    found = slim.select(text_col).mapInArrow(kernel, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    got = found.orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def keys(h: np.ndarray, often: np.ndarray, n: np.ndarray, similarity: float = SIMILARITY, crowd: int = CROWD) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set, as many as make sure that similar sets share one; and those that crowds share."""
    if not len(h):
        return h, h
    unshared = len(h) - ceil(similarity * len(h) - 1e-9)
    count = np.zeros(len(h), np.int64)
    if len(often):
        place = np.minimum(np.searchsorted(often, h), len(often) - 1)
        count = np.where(often[place] == h, n[place], 0)
    rare = h[count == 0]
    if len(rare) > unshared:
        return rare[: min(unshared + 1, ceil(log(MISS) / log(unshared / len(rare)))) if unshared else 1], h[:0]
    hot = np.nonzero(count)[0]
    hot = hot[np.argsort(count[hot], kind="stable")][: unshared + 1 - len(rare)]
    crowded = count[hot] > crowd
    return np.concatenate([rare, h[hot[~crowded]]]), h[hot[crowded]]


SKETCH = "digest binary, n int, f array<long>, keys array<long>, crowded array<long>"


def sketches(slim: DataFrame, text_col: str, similarity: float = SIMILARITY, block: int = BLOCK, crowd: int = CROWD, simhash: Callable[[str], int] | None = None) -> DataFrame:
    """slim with the digest of its words, the number of shingles, the fingerprint and the keys; with `simhash`, also fp, what that gives for a text (64 bits)."""
    sent = slim.sparkSession.sparkContext.broadcast(common(slim, text_col, block))  # COMMON x 16 bytes at most

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, n = sent.value
        longs = pa.list_(pa.int64())
        for part, values in texts(batches, text_col):
            digest, size, f, found, fp = [], [], [], [], []
            for x in values:
                w = words(x)
                h = hashes(w)
                digest.append(xxhash.xxh3_128_digest(b" ".join(w)))
                size.append(len(h))
                f.append(fingerprint(h).view(np.int64))
                found.append([k.view(np.int64) for k in keys(h, often, n, similarity, crowd)])
                fp += [simhash(x)] if simhash else []
            more = {"fp": pa.array(np.array(fp, np.uint64).view(np.int64))} if simhash else {}
            yield append(part, digest=pa.array(digest, pa.binary()), n=pa.array(size, pa.int32()), f=pa.array(f, longs), keys=pa.array([k for k, _ in found], longs), crowded=pa.array([k for _, k in found], longs), **more)

    return slim.mapInArrow(kernel, appended(slim.schema, SKETCH + ", fp long" if simhash else SKETCH))


def _pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray, f: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between rows of one key, which come together and by size: of equal connectivity as all pairs that may be similar."""

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (n[i] >= similarity * n[j] - 1e-9) & (np.bitwise_count(f[i] ^ f[j]).sum(1) <= FAR)

    out: list[tuple[int, int]] = []
    edges = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]])
    sizes = np.diff(edges)
    end = np.repeat(edges[1:], sizes)
    i = np.nonzero(np.repeat(sizes <= SMALL, sizes))[0]
    for d in range(1, SMALL):
        i = i[i + d < end[i]]
        if not len(i):
            break
        hit = i[near(i, i + d)]
        out += zip(node[hit].tolist(), node[hit + d].tolist())
    for g in np.nonzero(sizes > SMALL)[0].tolist():
        for a in range(int(edges[g]), int(edges[g + 1]), WINDOW):
            z = min(a + WINDOW, int(edges[g + 1]))
            if a > edges[g]:
                out.append((int(node[a - 1]), int(node[a])))
            group = np.arange(a, z)
            for i in range(a, z):
                j = i + 1 + np.nonzero(group[i + 1 - a :] != group[i - a])[0]
                j = j[near(np.full(len(j), i), j)]
                for x in np.unique(group[j - a]).tolist():
                    out.append((int(node[i]), int(node[x])))
                    group[group == x] = group[i - a]
    return forest(out)


def links(first: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """first: node, n, f, keys, crowded, materialized. Links (a, b) that connect all pairs that may be similar."""

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3 + FP_WORDS, 0), np.int64)
        chained = False

        def linked(rows: np.ndarray) -> pa.RecordBatch:
            got = _pairs(rows[0], rows[1], rows[2], rows[3:].T.view(np.uint64), similarity)
            if chained and rows.shape[1] > 1 and rows[0, 0] == rows[0, 1]:
                got.append((int(rows[1, 0]), int(rows[1, 1])))
            return _links(got)

        for b in batches:
            if not len(b):
                continue
            held = np.concatenate([held, np.stack([c.to_numpy() for c in b.columns])], axis=1)
            last = int(np.searchsorted(held[0], held[0, -1]))  # where the last key begins
            if held.shape[1] - last > WINDOW:
                yield linked(held)
                held, chained = held[:, -1:], True
            elif last:
                yield linked(held[:, :last])
                held, chained = held[:, last:], False
        if held.shape[1]:
            yield linked(held)

    def crowding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            out = []
            for node, crowds in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k in crowds:
                    out.append((node, seen.setdefault(k, node)))
            yield _links(forest(out))
        yield _links([(node, -1 - (k & (1 << 62) - 1)) for k, node in seen.items()])

    rows = first.select(F.explode("keys").alias("key"), "node", F.col("n").cast("long").alias("n"), *(F.col("f")[i].alias(f"f{i}") for i in range(FP_WORDS)))
    met = rows.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(meeting, "a long, b long")
    return met.union(first.where("size(crowded) > 0").select("node", "crowded").mapInArrow(crowding, "a long, b long"))


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Hashes thrown into PARITY_BITS cells; whether each holds an odd number. Two sets differ in at least as many hashes as cells."""
    out = np.zeros((len(sets), PARITY_BITS), np.uint8)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s * MIX >> np.uint64(40)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
    return np.packbits(out, axis=1).view(np.uint64)


def similar(own: np.ndarray, f: np.ndarray, sets: list[np.ndarray], similarity: float, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions of similar texts, as links that connect whatever is connected. Where `own` differs, rows are compared across only.

    Pairs of near fingerprints come first, as they are likely to connect; then all others that are not connected by then,
    as far as is known from `group`. What is left out before sets are compared can't be similar by its sizes or its parities.
    """
    n, cross = len(own), len(set(own.tolist())) > 1
    group = np.arange(n) if group is None else np.unique(group, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    size, odd = np.array([len(s) for s in sets]), parities(sets)

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        for a in range(0, len(x), 4096):
            p, q = x[a : a + 4096], y[a : a + 4096]
            left = group[p] != group[q]
            left &= np.minimum(size[p], size[q]) >= similarity * np.maximum(size[p], size[q]) - 1e-9
            p, q = p[left], q[left]
            differ = np.bitwise_count(odd[p] ^ odd[q]).sum(1, dtype=np.int64)
            left = differ * (1 + similarity) <= (1 - similarity) * (size[p] + size[q]) + 1e-6
            for i, j in zip(p[left].tolist(), q[left].tolist()):
                if group[i] != group[j]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both >= similarity * (size[i] + size[j] - both) - 1e-9:
                        out.append((i, j))
                        group[group == group[j]] = group[i]

    def distances(a: int) -> np.ndarray:
        """Bits between 256 fingerprints and all; 999 for pairs that aren't asked for."""
        far = np.bitwise_count(f[a : a + 256, None] ^ f[None]).sum(2, dtype=np.int16)
        far[np.arange(n)[None, :] <= np.arange(a, a + len(far))[:, None]] = 999
        if cross:
            far[own[a : a + 256, None] == own[None, :]] = 999
        return far

    near = [np.zeros((3, 0), np.int64)]
    for a in range(0, n, 256):
        far = distances(a)
        x, y = np.nonzero(far <= NEAR_BITS)
        near.append(np.stack([far[x, y], x + a, y]))
    far, x, y = np.concatenate(near, axis=1)
    order = np.argsort(far, kind="stable")
    compare(x[order], y[order])
    for a in range(0, n, 256):
        far = distances(a)
        x, y = np.nonzero((far > NEAR_BITS) & (far < 999) & (group[a : a + 256, None] != group[None, :]))
        compare(x + a, y)
    return out


def _compared(rows: DataFrame, by: int, similarity: float) -> DataFrame:
    """rows: `by` longs that name a comparison, then side, label, node, f, h. Links (a, b) of similar texts of two labels, across sides if there are two."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, by):
            if len(t) > 1:
                side, label, node = (t.column(by + i).to_numpy() for i in range(3))
                f = t.column(by + 3).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, FP_WORDS)
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(by + 4)]
                got = similar(side, f, sets, similarity, label)
                yield _links([(int(node[p]), int(node[q])) for p, q in got])

    named_ = rows.columns[:by]
    return rows.repartition(*named_).sortWithinPartitions(*named_, "node").mapInArrow(kernel, "a long, b long")


def _across(some: DataFrame, every: DataFrame, similarity: float, chunk: int = ACROSS) -> DataFrame:
    """family, label, node, f, h of each. Links between some rows and all of their family, if their labels differ. Each chunk of some meets each chunk of all."""

    def chunks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("family").agg(F.expr(f"greatest((count(1) + {chunk - 1}) div {chunk}, sum(octet_length(h)) div {CHUNK_BYTES} + 1)").alias(name))

    sizes = materialize(chunks(some, "is").join(chunks(every, "js"), "family"), "chunks")

    def dealt(rows: DataFrame, side: int, own: str, other: str) -> DataFrame:
        of, met = f"{own}s", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1))
        return rows.join(sizes, "family").select("*", F.pmod(F.xxhash64("node"), of).alias(own), met.alias(other), F.lit(side).cast("long").alias("side")).select("family", "i", "j", "side", "label", "node", "f", "h")

    return _compared(dealt(some, 0, "i", "j").union(dealt(every, 1, "j", "i")), 3, similarity)


def verified(families: DataFrame, found: DataFrame, text_col: str, similarity: float = SIMILARITY, chunk: int = FAMILY, across: int = ACROSS) -> DataFrame:
    """families: node (a rid of found), n, family. Links (a, b) of similar texts that connect whatever is connected within families."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in texts(batches, "t"):
            sets = [hashes(words(x)) for x in values]
            f = pa.array([fingerprint(h).view(np.int64) for h in sets], pa.list_(pa.int64()))
            yield append(part.select(["family", "own", "chunks", "node"]), f=f, h=pa.array([h.tobytes() for h in sets], pa.binary()))

    parts = F.expr(f"greatest((count(1) + {chunk - 1}) div {chunk}, sum(8L * n) div {CHUNK_BYTES} + 1)")
    sized = families.join(families.groupBy("family").agg(F.count(F.lit(1)).alias("size"), parts.alias("chunks")).where("size > 1"), "family")
    sized = sized.select("family", F.pmod(F.xxhash64("node"), "chunks").alias("own"), "chunks", "node")
    rows = found.select("rid", F.col(text_col).alias("t")).join(sized.hint("merge"), F.col("rid") == sized["node"])
    members = materialize(rows.select("family", "own", "chunks", "node", "t").mapInArrow(hashed, "family long, own long, chunks long, node long, f array<long>, h binary"), "shingles", even=True)
    inside = members.select("family", "own", F.lit(0).cast("long").alias("side"), F.col("node").alias("label"), "node", "f", "h")
    out = materialize(_compared(inside, 2, similarity), "copies", even=True)
    large = members.where("chunks > 1")
    if not large.select("node").head(1):
        return out

    sets = large.select("node", "f", "h")
    for one_of_each in (True, False):
        # Narrow rows first: each node with the smallest node of its group so far. Sets are fetched for families in parts only.
        now = materialize(large.select("family", "node").join(components(out), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "labels", even=True)
        sizes = now.groupBy("family", "label").agg(F.count(F.lit(1)).alias("size"))
        largest = sizes.groupBy("family").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.count(F.lit(1)).alias("groups")).where("groups > 1").drop("groups")
        open_ = now.join(largest, "family")
        some = open_.where("node = label") if one_of_each else open_.where("label <> largest")
        more = _across(some.join(sets, "node"), (some if one_of_each else open_).join(sets, "node"), similarity, across)
        out = materialize(out.union(more), "copies", even=True)
    return out


def _near_marks(first: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """first: node, fp, materialized. Links (a, b) of nodes that connect those of equal fp and of linked ones (a, b of fp)."""
    heads = materialize(first.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = first.select("node", "fp").join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    a, b = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab")
    return same.union(linked(heads.select("fp")).join(a, "a").join(b, "b").select("head_a", "head_b"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, chunk: int = BLOCK, family: int = FAMILY, across: int = ACROSS, crowd: int = CROWD, simhash: Callable[[str], int] | None = None, linked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The documents with one row of each group left: that of the smallest id (of repeated rows, one). simhash: the 64-bit fingerprint of a text; linked: of a column fp of these, the links (a, b), which are candidates beside those of shared keys."""
    slim, t = numbered(docs, text_col)
    found = materialize(sketches(slim, t, similarity, chunk, crowd, simhash).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    i = F.col(f"c{docs.columns.index(id_col)}")
    order = F.struct(i.isNull().alias("none"), i.alias("id"), "rid")
    marks = ["fp"] if simhash else []
    with owned("near copies"):
        first = found.groupBy("digest").agg(F.min(order).alias("o"), *(F.first(c).alias(c) for c in ("n", "f", "keys", "crowded", *marks)))
        first = materialize(first.select(F.col("o.rid").alias("node"), "o", "n", "f", "keys", "crowded", *marks), "nodes")
        met = links(first, similarity)
        loose = components(met.union(_near_marks(first, linked)) if simhash else met)
        rows = loose.select("node", F.col("root").alias("family")).union(loose.select("root", "root").distinct())
        families = materialize(rows.join(first.select("node", "n"), "node"), "families")
        grouped = components(verified(families, found, t, similarity, family, across))
    grouped = first.select("node", "o").join(grouped, "node", "left").select(F.coalesce("root", "node").alias("root"), "o")
    winners = materialize(grouped.groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.rid").alias("rid")), "winners")
    release("near copies")
    return named(found.join(winners.hint("merge"), "rid", "left_semi"), docs.columns)
