"""Token ids in binary blocks, packed by best-fit decreasing.

A document is its byte-level BPE ids and an end id, so its text comes back from its ids. Documents longer than a row are
cut into full rows and a rest, and nothing is dropped. Pieces are placed from the longest down, each into the open row with
the least room that still takes it; rows are found by their room in a segment tree over all possible rooms, in as many
steps as the row width has bits.

Each task packs its own input in buffers of about BUFFER tokens and writes a block for each:
  ids           rows x width token ids, little-endian unsigned 16 bits (32 where the vocabulary needs it), END_ID as padding
  cu_seqlens    int32 bounds of all segments in the flattened matrix, from 0 to rows x width; a row's padding is a segment
  positions     unsigned 16 or 32 bits: each token's place in its segment, 0 where one begins
  doc_ids, starts, doc_tokens    of each segment: its document, its first id's place in it, its document's ids (null, -1, 0: padding)
Blocks are Parquet rows written by Spark, so they commit with their task on any file system. There is no shuffle.

Defined cases: a null text is empty and is its end id alone; very long texts are encoded whole, but for runs of white space
beyond LONG_GAP, which the tokenizer can't take and gets in parts of that length; of pieces of equal length the one that was
read first is placed first; repeated rows are packed each; rows without an id are packed too (their doc_tokens tell them from
padding); an empty table gives no blocks; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vecloom.llm.common import at, texts

WIDTH = 2048
BUFFER = 1 << 19
END_ID = 50256
LONG_GAP = 1 << 15
#: Fixed value: how the vocabulary's text is cut into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Rooms:
    """A segment tree over rooms 0 to width, with the open rows of each."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The room and row with the least room of at least `least`; the row leaves."""
        count, i = self.count, least + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up to where a right neighbour has any
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i *= 2
                i += not count[i]
        room = i - self.size
        row = self.rows[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, row


def place(lengths: list[int], width: int = WIDTH) -> list[list[tuple[int, int, int]]]:
    """Rows of (document, start, length): best-fit decreasing over documents and the parts of overlong ones."""
    rows: list[list[tuple[int, int, int]]] = []
    pieces = []
    for d, n in enumerate(lengths):
        whole = n - n % width
        rows += [[(d, s, width)] for s in range(0, whole, width)]
        if n > whole:
            pieces.append((n - whole, d, whole))
    rooms = Rooms(width)
    for n, d, s in sorted(pieces, key=lambda p: (-p[0], p[1])):
        room, row = rooms.take(n) or (width, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append((d, s, n))
        if room > n:
            rooms.add(room - n, row)
    return rows


_loaded: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """A tokenizer from a file of base64 tokens and ranks; one for each Python worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def encode(tokens: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= LONG_GAP:
        return tokens.encode_ordinary(text)
    cuts = [m.end() for m in re.finditer(rf"\s{{{LONG_GAP}}}", text)]
    return [i for a, z in zip([0, *cuts], [*cuts, len(text)]) for i in tokens.encode_ordinary(text[a:z])]


BLOCK = "block_id long, rows int, width int, ids binary, cu_seqlens binary, positions binary, doc_ids array<{}>, starts array<long>, doc_tokens array<long>"


def blocks(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, buffer_tokens: int = BUFFER, end_id: int = END_ID) -> DataFrame:
    """The packed blocks; write them as Parquet."""
    slim = docs.select(at(id_col).alias("id"), at(text_col).cast("string").alias("t"))
    kind = "<u2" if end_id < 1 << 16 and width <= 1 << 16 else "<u4"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(tokenizer_path)
        names: list = []
        held: list[np.ndarray] = []
        total, made, id_type = 0, TaskContext.get().partitionId() << 32, None

        def block() -> pa.RecordBatch:
            rows = place([len(x) for x in held], width)
            ids = np.full(len(rows) * width, end_id, kind)
            bounds, docs_, starts, sizes = [0], [], [], []
            for r, row in enumerate(rows):
                i = r * width
                for d, s, n in row:
                    ids[i : i + n] = held[d][s : s + n]
                    i += n
                    bounds.append(i)
                    docs_.append(names[d])
                    starts.append(s)
                    sizes.append(len(held[d]))
                if i < (r + 1) * width:
                    bounds.append((r + 1) * width)
                    docs_.append(None)
                    starts.append(-1)
                    sizes.append(0)
            cu = np.array(bounds, "<i4")
            positions = (np.arange(len(ids)) - np.repeat(cu[:-1], np.diff(cu))).astype(kind)
            column = lambda x, t: pa.array([x], t)
            names_type = pa.list_(id_type)
            return pa.RecordBatch.from_arrays(
                [column(made, pa.int64()), column(len(rows), pa.int32()), column(width, pa.int32()), *(column(x.tobytes(), pa.binary()) for x in (ids, cu, positions)), column(docs_, names_type), *(column(x, pa.list_(pa.int64())) for x in (starts, sizes))],
                ["block_id", "rows", "width", "ids", "cu_seqlens", "positions", "doc_ids", "starts", "doc_tokens"],
            )

        for part, values in texts(batches, "t"):
            id_type = part.schema.field("id").type
            for name, text in zip(part.column("id").to_pylist(), values, strict=True):
                names.append(name)
                held.append(np.array([*encode(tokens, text), end_id], kind))
                total += len(held[-1])
                if total >= buffer_tokens:
                    yield block()
                    names, held, total, made = [], [], 0, made + 1
        if held:
            yield block()

    return slim.mapInArrow(kernel, BLOCK.format(slim.schema["id"].dataType.simpleString()))


def read_pieces(packed: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each piece of the blocks: id_col, start, length, ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset; ids on demand. Bounds and position resets are checked."""
    id_type = packed.schema["doc_ids"].dataType.elementType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        for b in batches:
            for i in range(b.num_rows):  # blocks are large: one at a time
                r = b.slice(i, 1).to_pylist()[0]
                cu = np.frombuffer(r["cu_seqlens"], "<i4").astype(np.int64)
                kind = "<u2" if len(r["ids"]) == 2 * r["rows"] * r["width"] else "<u4"
                ids, positions = np.frombuffer(r["ids"], kind).astype("<u4"), np.frombuffer(r["positions"], kind)
                if cu[-1] != len(ids) or len(positions) != len(ids) or (np.nonzero(positions == 0)[0] != cu[:-1]).any():
                    raise ValueError(f"block {r['block_id']} is damaged")
                rows, names = [], []
                for a, z, name, start, n in zip(cu.tolist(), cu[1:].tolist(), r["doc_ids"], r["starts"], r["doc_tokens"]):
                    if n:
                        names.append(name)
                        rows.append((start, z - a, zlib.crc32(ids[a:z].tobytes()), n, (r["block_id"] << 20) + a // r["width"], a % r["width"], ids[a:z].astype(np.int32) if with_ids else None))
                columns = list(zip(*rows)) or [[]] * 7
                name_type = b.schema.field("doc_ids").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(names, name_type), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    out = packed.mapInArrow(kernel, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>").withColumnRenamed("id", id_col)
    return out if with_ids else out.drop("ids")
