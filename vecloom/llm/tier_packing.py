"""Hierarchical multi-length packing: documents go to context-size tiers, each tier fills its own windows.

A document is its ids and an end id. Stretches of a whole long window are windows at once; what is left of a document is
routed to the smallest tier that holds it. Tiers are served from the longest down: a piece opens a window of its tier, the
gap behind it takes the largest pieces of shorter tiers that fit, and what remains is filled exactly by cutting one.
Windows of the shortest tier are filled likewise. So all windows are full, to a power of two; only a task's very last
pieces, less than one long window, make a sequence that is padded.

Step groups hold `step_tokens` tokens each (the last of a buffer may hold less): the windows of a buffer are interleaved
by their fractional rank within their tier and cut by tokens, so steps are alike in tokens and in their mix of lengths.

Each task packs its own input in buffers of about BUFFER tokens. Nothing is shuffled, and a lost task is packed anew
with the same ids and sequences, as long as its input is split alike.

Defined cases: a null text is empty and is its end id alone; very long texts are encoded whole and cut into windows; of pieces
of equal length the one that came last is taken first; repeated rows are packed each; rows without an id are packed too; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vecloom.llm.common import at, texts
from vecloom.llm.word_tokens import words

TIERS = (512, 1024, 2048)
STEP_TOKENS = 1 << 16
BUFFER = 1 << 21
END_ID = 1

Piece = tuple[int, int, int]  # document, start, length


class _Pool:
    """Pieces by length: the largest that fits, and cutting."""

    def __init__(self):
        self.by: dict[int, list[Piece]] = {}
        self.lengths: list[int] = []
        self.tokens = 0

    def add(self, p: Piece) -> None:
        if p[2] not in self.by:
            insort(self.lengths, p[2])
            self.by[p[2]] = []
        self.by[p[2]].append(p)
        self.tokens += p[2]

    def take(self, most: int) -> Piece | None:
        """The largest piece of at most this length."""
        i = bisect_right(self.lengths, most)
        if not i:
            return None
        n = self.lengths[i - 1]
        p = self.by[n].pop()
        if not self.by[n]:
            del self.by[n], self.lengths[i - 1]
        self.tokens -= n
        return p

    def longest(self) -> Piece | None:
        return self.take(1 << 62)


def pack(lengths: list[int], carried: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows as (size, pieces) over documents 0, 1, ... of these lengths and carried pieces; and the pieces left, less than the longest tier."""
    top = tiers[-1]
    pools = [_Pool() for _ in tiers]
    windows: list[tuple[int, list[Piece]]] = []

    def route(p: Piece) -> None:
        d, start, n = p
        while n >= top:
            windows.append((top, [(d, start, top)]))
            start, n = start + top, n - top
        if n:
            pools[next(i for i, t in enumerate(tiers) if n <= t)].add((d, start, n))

    for p in carried:
        route(p)
    for d, n in enumerate(lengths):
        route((d, 0, n))

    def fill(gap: int, upto: int) -> list[Piece]:
        """Pieces of tiers up to this one, of `gap` tokens in all; there are enough."""
        got = []
        while gap:
            p = next((p for pool in reversed(pools[: upto + 1]) if (p := pool.take(gap))), None)
            if p is None:  # all are longer: the shortest tier that has any gives a part of its longest
                d, start, n = next(p for pool in pools[: upto + 1] if (p := pool.longest()))
                p = d, start, gap
                route((d, start + gap, n - gap))
            got.append(p)
            gap -= p[2]
        return got

    for i in range(len(tiers) - 1, -1, -1):
        while pools[i].tokens:
            first = pools[i].longest()
            gap = tiers[i] - first[2]
            # Shorter tiers fill the gap; only if they can't, pieces of this tier do.
            below = sum(pool.tokens for pool in pools[:i])
            if below >= gap:
                windows.append((tiers[i], [first, *fill(gap, i - 1)] if gap else [first]))
            elif below + pools[i].tokens >= gap:
                windows.append((tiers[i], [first, *fill(gap, i)]))
            else:
                pools[i].add(first)
                break
    left = [p for pool in pools for p in iter(pool.longest, None)]
    return windows, left


def steps(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[tuple[int, int]]:
    """(step, window) in step order."""
    of: dict[int, list[int]] = {}
    for w, (size, _) in enumerate(windows):
        of.setdefault(size, []).append(w)
    order = sorted(((i + 0.5) / len(ws), -size, w) for size, ws in of.items() for i, w in enumerate(ws))
    out, total = [], 0
    for _, _, w in order:
        out.append((total // step_tokens, w))
        total += windows[w][0]
    return out


SCHEMA = "id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids array<int>"


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, buffer_tokens: int = BUFFER, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (tokens the sequence takes, padding included), step_group; ids on demand."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = words(tokenizer_path)
        first = TaskContext.get().partitionId() << 32
        made = grouped = 0
        names: list = []  # of the documents in the buffer
        held: list[np.ndarray] = []
        carried: list[Piece] = []
        fresh = total = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal made, grouped, names, held, carried, fresh, total
            # Documents before `fresh` are here for their carried pieces only.
            windows, left = pack([0] * fresh + [len(x) for x in held[fresh:]], carried, tiers)
            if last and left:
                windows.append((tiers[-1], left))
                left = []
            rows = []
            for step, w in steps(windows, step_tokens):
                size, pieces = windows[w]
                at_ = 0
                for d, start, n in pieces:
                    ids = held[d][start : start + n]
                    rows.append((names[d], start, n, zlib.crc32(ids.astype("<u4").tobytes()), len(held[d]), first + made, at_, size, first + grouped + step, ids.astype(np.int32) if with_ids else None))
                    at_ += n
                made += 1
            grouped += sum(size for size, _ in windows) // step_tokens + 1
            kept = {d: i for i, d in enumerate(dict.fromkeys(d for d, _, _ in left))}
            names, held = [names[d] for d in kept], [held[d] for d in kept]
            carried, fresh, total = [(kept[d], s, n) for d, s, n in left], len(kept), 0
            columns = list(zip(*rows)) or [[]] * 10
            kinds = [id_type, *[pa.int64()] * 6, pa.int32(), pa.int64(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids"])

        id_type = None
        for part, values in texts(batches, "t"):
            id_type = part.schema.field("id").type
            for name, ids in zip(part.column("id").to_pylist(), tokens.encode(values), strict=True):
                names.append(name)
                held.append(np.append(ids, np.uint32(END_ID)))
                total += len(held[-1])
                if total >= buffer_tokens:
                    yield flush(False)
        if id_type is not None:
            yield flush(True)

    slim = docs.select(at(id_col).alias("id"), at(text_col).cast("string").alias("t"))
    out = slim.mapInArrow(kernel, SCHEMA.format(slim.schema["id"].dataType.simpleString())).withColumnRenamed("id", id_col)
    return out if with_ids else out.drop("ids")
