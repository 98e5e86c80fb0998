"""Benchmark decontamination with suffix arrays.

Words are lowered (A-Z) runs of digits, a-z and characters beyond ASCII. A window is ten consecutive words of a benchmark
item; an item of fewer words, but not none, is one window. Every document word inside an occurrence of a window is hit.

Documents are read in shards of some 8 MB. Of a shard, only runs of words known to the benchmark that are long enough
for its shortest window are kept; their suffixes are sorted by prefix doubling to the depth of the longest window. Each
benchmark suffix is then found by binary search, all at once: the range of document suffixes that begin with its window
gives the occurrences and where they are. From each of these places the longest verbatim match is found by binary search
the other way, in the suffix array of the benchmark, doubling and halving steps: stretches of 1, 2, 4, ... words are ranked
among the benchmark's stretches of that length, and a step is taken if its rank occurs in the range of suffixes found so far.
So time and memory are in proportion to words (times the logarithm of the longest item), however long an item is.

The benchmark is read in blocks of at most BLOCK_BYTES of text, one item at least; only indexes of PASS_BLOCKS blocks are
broadcast at a time. A larger benchmark takes further passes over the documents, with the findings so far written in
between, so no broadcast grows with its size. Everything else is one pass without a shuffle.

Defined cases: null texts have no words and are never hit; very long texts and items are taken whole; an item without an id
has the empty id, and items of one id count once; repeated rows get a result each; of equally long matches the first in the
document is told; an empty table gives an empty result, an empty benchmark hits nothing; other columns may have any names,
report() ignores them and remove() keeps them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from vecloom.llm.common import at, materialize, named, numbered, texts

WINDOW = 10
BLOCK_BYTES, PASS_BLOCKS = 2 << 20, 4

_LOWER = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def ranks(x: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By prefix doubling: for 2, 4, ... up to at least `depth` tokens, the distinct codes of stretches, in order, and each place's rank among them.

    The code of a stretch is its halves' ranks, the first one times the number of ranks and more.
    """
    rank, h = x.astype(np.int64), 1
    while h < depth:
        after = np.zeros_like(rank)
        after[:-h] = rank[h:]
        distinct, rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)
        h *= 2
        yield distinct, rank


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions of non-zero tokens of x, ordered by their next `depth` tokens at least. Zeros separate runs."""
    rank = x
    for distinct, rank in ranks(x, depth):
        if len(distinct) == len(x):
            break
    order = np.argsort(rank, kind="stable")
    return order[x[order] > 0]


def search(x: np.ndarray, sa: np.ndarray, q: np.ndarray, right: bool = False) -> np.ndarray:
    """Binary search of all rows of q at once: how many suffixes in sa come before each row, or with `right`, before or begin with it."""
    x = np.concatenate([x, np.zeros(q.shape[1], x.dtype)])
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(sa), np.int64)
    step, row = np.arange(q.shape[1]), np.arange(len(q))
    while (live := lo < hi).any():
        mid = np.where(live, (lo + hi) // 2, 0)
        diff = x[sa[mid][:, None] + step].astype(np.int64) - q
        there = diff[row, (diff != 0).argmax(1)]
        less = (there < 0) | (right & (there == 0))
        lo, hi = np.where(live & less, mid + 1, lo), np.where(live & ~less, mid, hi)
    return lo


@dataclass
class Index:
    """A block of the benchmark: its vocabulary, distinct windows by length with their items, and its suffix array."""

    items: list[tuple[str, list[bytes]]]
    window: int = WINDOW
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        self.names = sorted({name for name, _ in self.items})
        number = {name: i for i, name in enumerate(self.names)}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        tokens, owner, place = [], [], []
        for name, w in self.items:
            ids = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]
            length = min(self.window, len(ids))
            for j in range(len(ids) - length + 1 if ids else 0):
                found.setdefault(length, {}).setdefault(tuple(ids[j : j + length]), set()).add(number[name])
            tokens += [*ids, 0]
            owner += [number[name]] * (len(ids) + 1)
            place += range(len(ids) + 1)
        self.depth = max((len(w) for _, w in self.items), default=0)
        self.tokens, self.owner, self.place = (np.array(v, np.int32) for v in (tokens, owner, place))
        self.sa = suffix_array(self.tokens, self.depth) if self.depth else np.zeros(0, np.int64)
        # Of stretches of 2, 4, ... words that items are long enough for: their codes, and the ranks that tokens have by them.
        self.levels = [(distinct, rank.astype(np.int32)) for i, (distinct, rank) in enumerate(ranks(self.tokens, self.depth)) if 2 << i <= self.depth]
        self.windows = [(n, np.array(list(by), np.int32), [sorted(v) for v in by.values()]) for n, by in sorted(found.items())]
        self.items = []

    def longest(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For places in x, the length of the longest match with any item, and its place in the benchmark's tokens."""
        # The ranks that x's stretches have in the benchmark; -1 where they don't occur there.
        own = [np.where(x > 0, x, -1).astype(np.int64)]
        theirs = [self.tokens]
        for i, (distinct, rank) in enumerate(self.levels):
            half, after = own[-1], np.full(len(x), -1, np.int64)
            after[: -(1 << i)] = half[1 << i :]
            code = half * (int(theirs[-1].max()) + 1) + after
            where = np.minimum(np.searchsorted(distinct, code), len(distinct) - 1)
            own.append(np.where((half >= 0) & (after >= 0) & (distinct[where] == code), where, -1))
            theirs.append(rank)
        n = np.zeros(len(starts), np.int64)
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.sa), np.int64)
        for i in [*range(len(own)), *range(len(own) - 1, -1, -1)]:
            # Suffixes from lo to hi share n tokens with x, so those behind are in order.
            place = np.minimum(starts + n, len(x) - 1)
            q = np.where(starts + n < len(x), own[i][place], -1)
            begin, end = self._range(theirs[i], n, q, lo, hi)
            more = (q >= 0) & (begin < end)
            lo, hi, n = np.where(more, begin, lo), np.where(more, end, hi), n + np.where(more, 1 << i, 0)
        return n, self.sa[np.minimum(lo, len(self.sa) - 1)]

    def _range(self, rank: np.ndarray, n: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes between lo and hi whose rank behind n tokens is q."""
        out = []
        for side in (0, 1):
            a, z = lo.copy(), hi.copy()
            while (live := a < z).any():
                mid = np.where(live, (a + z) // 2, 0)
                there = rank[np.minimum(self.sa[mid] + n, len(rank) - 1)]
                less = (there < q) | ((there == q) & bool(side))
                a, z = np.where(live & less, mid + 1, a), np.where(live & ~less, mid, z)
            out.append(a)
        return out[0], out[1]

    def scan(self, docs: list[list[bytes]]) -> list[dict | None]:
        """For each document None, or its hit intervals of words, its items, and its longest match."""
        out: list[dict | None] = [None] * len(docs)
        if not self.windows:
            return out
        least, longest_window = self.windows[0][0], self.windows[-1][0]
        get = self.vocabulary.get
        sizes = np.fromiter((len(w) + 1 for w in docs), np.int64, len(docs))
        begins = np.concatenate([[0], np.cumsum(sizes)])
        x = np.fromiter((t for w in docs for t in (*(get(v, 0) for v in w), 0)), np.int32, begins[-1])
        # Runs of known words that are long enough, each with the zero after it.
        zero = np.nonzero(x == 0)[0]
        gaps = np.diff(np.concatenate([[-1], zero])) - 1
        keep = gaps >= least
        if not keep.any():
            return out
        lengths = gaps[keep] + 1
        ends = np.cumsum(lengths)
        origin = np.arange(ends[-1]) + np.repeat(zero[keep] + 1 - ends, lengths)
        run = x[origin]
        sa = suffix_array(run, longest_window)
        mark = np.zeros(len(x) + 1, np.int32)
        pairs, starts = [], []
        base = 0
        for n, q, _ in self.windows:
            lo, hi = search(run, sa, q), search(run, sa, q, right=True)
            count = hi - lo
            which = np.repeat(np.arange(len(q)), count)
            at_ = sa[np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)]
            p = origin[at_]
            np.add.at(mark, p, 1)
            np.add.at(mark, p + n, -1)
            starts.append(at_)
            pairs.append(np.stack([np.searchsorted(begins, p, "right") - 1, which + base], 1))
            base += len(q)
        of = [v for _, _, items in self.windows for v in items]
        pairs = np.unique(np.concatenate(pairs), axis=0)
        for d, w in pairs.tolist():
            if out[d] is None:
                out[d] = {"items": set(), "hits": [], "longest": (0, 0, "", 0)}
            out[d]["items"].update(of[w])
        hit = np.concatenate([[0], (np.cumsum(mark[:-1]) > 0).astype(np.int8), [0]])
        edges = np.nonzero(np.diff(hit))[0]
        for a, b in edges.reshape(-1, 2).tolist():
            d = int(np.searchsorted(begins, a, "right")) - 1
            out[d]["hits"].append((a - int(begins[d]), b - int(begins[d])))
        starts = np.unique(np.concatenate(starts))
        n, where = self.longest(run, starts)
        of_doc = np.searchsorted(begins, origin[starts], "right") - 1
        for i in np.lexsort((-origin[starts], n)).tolist():  # the last one stays: the longest, of these the first
            d = int(of_doc[i])
            out[d]["longest"] = (int(n[i]), int(origin[starts[i]] - begins[d]), self.names[self.owner[where[i]]], int(self.place[where[i]]))
        for found in out:
            if found:
                found["items"] = [self.names[i] for i in sorted(found["items"])]
        return out


def blocks(items: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Index]:
    """Indexes of bounded size over all items, in turn."""
    held: list[tuple[str, list[bytes]]] = []
    total = 0
    for name, text in items.select(F.coalesce(at(item_col).cast("string"), F.lit("")), F.coalesce(at(text_col).cast("string"), F.lit(""))).toLocalIterator():
        size = len(text.encode("utf-8", "surrogatepass"))
        if held and total + size > block_bytes:
            yield Index(held, window)
            held, total = [], 0
        held.append((name, words(text)))
        total += size
    yield Index(held, window)


FOUND = "struct<n_words: long, hits: array<struct<a: int, b: int>>, items: array<string>, longest: struct<words: int, word: int, item: string, item_word: int>>"


def _joined(old: dict | None, new: dict | None) -> dict | None:
    if not old or not new:
        return new or old
    hits: list[tuple[int, int]] = []
    for a, b in sorted([*old["hits"], *new["hits"]]):
        if hits and a <= hits[-1][1]:
            hits[-1] = hits[-1][0], max(b, hits[-1][1])
        else:
            hits.append((a, b))
    return {"hits": hits, "items": sorted({*old["items"], *new["items"]}), "longest": max(old["longest"], new["longest"], key=lambda x: x[0])}


def find(docs: DataFrame, items: DataFrame, carry: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """The carried columns, numbered, and `found`: n_words, hits (intervals of words), items, longest match and where."""
    spark = docs.sparkSession
    state, text = numbered(docs, text_col, carry)
    state = state.withColumn("found", F.lit(None).cast(FOUND))

    def one(state: DataFrame, indexes: list[Index], last: bool) -> DataFrame:
        sent = [spark.sparkContext.broadcast(x) for x in indexes]
        schema = T.StructType([f for f in state.schema if not (last and f.name == "t")])

        def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, values in texts(batches, text):
                split = [words(x) for x in values]
                found: list[dict | None] = [old and {"hits": [(h["a"], h["b"]) for h in old["hits"]], "items": old["items"], "longest": tuple(old["longest"].values())} for old in part.column("found").to_pylist()]
                for index in sent:
                    found = [_joined(old if old and old["hits"] else None, new) for old, new in zip(found, index.value.scan(split), strict=True)]
                out = []
                for w, f in zip(split, found):
                    f = f or {"hits": [], "items": [], "longest": (0, 0, "", 0)}
                    out.append({"n_words": len(w), "hits": [{"a": a, "b": b} for a, b in f["hits"]], "items": f["items"], "longest": dict(zip(("words", "word", "item", "item_word"), f["longest"]))})
                i = part.schema.get_field_index("found")
                yield part.set_column(i, part.schema.field(i), pa.array(out, part.schema.field(i).type)).select(schema.names)

        return state.mapInArrow(kernel, schema)

    ready = blocks(items, item_col, item_text_col, window, block_bytes)
    now = list(islice(ready, pass_blocks))
    while following := list(islice(ready, pass_blocks)):
        state, now = materialize(one(state, now, False), "decontam"), following
    return one(state, now, True)


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row for each document: id_col, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match with its places."""
    f = find(docs, items, [id_col], **how)
    n_hit = F.aggregate("found.hits", F.lit(0).cast("long"), lambda s, h: s + h["b"] - h["a"])
    return f.select(
        F.col("c0").alias(id_col),
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("found.longest.words").alias("longest_match"),
        F.col("found.longest.word").alias("match_word"),
        F.col("found.longest.item").alias("match_item"),
        F.col("found.longest.item_word").alias("match_item_word"),
    )


def remove(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents without any hit, with their own columns."""
    return named(find(docs, items, docs.columns, **how).where(F.size("found.hits") == 0), docs.columns)
