"""Binary pages of graph nodes, and single-node records: encoding, decoding and lookups.

A page has a fixed size and so many slots as fit. It holds its id and its number of nodes; then, each for all slots, ids, degrees,
vectors, neighbours, and the neighbours' codes; little endian, free slots and neighbours as 2**32 - 1, zeros behind. A record
of RECORD_BYTES holds one node with a checksum of its payload. An index of one node a page is a page file with one slot.

Pages and records are binary columns: a table of them is kept as Parquet, by (page_id, page) or (id, record), so a lookup is
a filter that reaches the scan. Vectors are kept as 32-bit floats and ids as unsigned 32-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecloom.functions.vectors import nodes_per_page

NONE = (1 << 32) - 1
#: Fixed values of a record: its size, its mark, and its head.
RECORD_BYTES, MAGIC = 4096, 0x52444941
HEAD = np.dtype([("magic", "<u4"), ("node_id", "<u4"), ("degree", "<u2"), ("dim", "<u2"), ("code_bytes", "<u2"), ("flags", "<u2"), ("checksum", "<u4"), ("vector_offset", "<u4"), ("neighbors_offset", "<u4"), ("payload_bytes", "<u4")])
#: Fixed values of the checksum: FNV-1a of 32 bits.
FNV_START, FNV_PRIME = np.uint32(2166136261), np.uint32(16777619)


def fnv1a(rows: np.ndarray, start: np.ndarray | np.uint32 = FNV_START) -> np.ndarray:
    """The checksum of each row of bytes; `start` carries on from bytes before."""
    out = np.full(len(rows), start, np.uint32)
    for column in rows.T.astype(np.uint32):
        out = (out ^ column) * FNV_PRIME
    return out


def layout(dim: int, degree: int, page_size: int = 4096, code_bytes: int = 0, slots: int | None = None) -> np.dtype:
    """The page as a record type; what is left of the page's size is padding."""
    n = nodes_per_page(page_size, dim, degree, code_bytes) if slots is None else slots
    fields = [("page_id", "<u4"), ("count", "<u4"), ("ids", "<u4", n), ("degrees", "<u4", n), ("v", "<f4", (n, dim)), ("nbrs", "<u4", (n, degree)), ("codes", "u1", (n, degree, code_bytes))]
    size = np.dtype(fields).itemsize
    if n < 1 or size > page_size:
        raise ValueError("a node doesn't fit in a page")
    return np.dtype([*fields, ("rest", "V", page_size - size)] if page_size > size else fields)


def encode(nodes: DataFrame, placed: DataFrame, dim: int, degree: int, page_size: int = 4096, code_bytes: int = 0, slots: int | None = None) -> DataFrame:
    """nodes: id, v, nbrs, and with code_bytes, codes (of all neighbours, joined). placed: id, page_id, slot. Gives page_id, page."""
    kind = layout(dim, degree, page_size, code_bytes, slots)
    codes = F.col("codes") if code_bytes else F.lit(None).cast("binary")
    rows = placed.join(nodes.select("id", F.col("v").cast("array<float>").alias("v"), F.col("nbrs").cast("array<long>").alias("nbrs"), codes.alias("codes")), "id")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, done = None, []
        for b in batches:
            for r in b.to_pylist():
                if page is None or page["page_id"] != r["page_id"]:
                    done += [] if page is None else [page]
                    page = np.zeros((), kind)
                    page["page_id"], page["ids"], page["nbrs"] = r["page_id"], NONE, NONE
                nbrs, slot = r["nbrs"] or [], r["slot"]
                if len(r["v"]) != dim or len(nbrs) > degree or slot >= len(page["ids"]):
                    raise ValueError(f"node {r['id']} doesn't fit in its page")
                page["count"] += 1
                page["ids"][slot], page["degrees"][slot], page["v"][slot], page["nbrs"][slot][: len(nbrs)] = r["id"], len(nbrs), r["v"], nbrs
                if code_bytes:
                    page["codes"][slot][: len(nbrs)] = np.frombuffer(r["codes"], np.uint8).reshape(len(nbrs), code_bytes)
            yield _pages(done)
            done = []
        yield _pages([] if page is None else [page])

    columns = ["page_id", "slot", "id", "v", "nbrs", "codes"]
    return rows.select(columns).repartition("page_id").sortWithinPartitions("page_id", "slot").mapInArrow(kernel, "page_id long, page binary")


def _pages(pages: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(p["page_id"]) for p in pages], pa.int64()), pa.array([p.tobytes() for p in pages], pa.binary())], ["page_id", "page"])


def decode_page(page: bytes, kind: np.dtype, page_id: int | None = None) -> list[tuple[int, int, list[float], list[int], bytes]]:
    """Slot, id, vector, neighbours and codes of a page's nodes. A page of another size, id or count is damaged."""
    if len(page) != kind.itemsize:
        raise ValueError(f"a page of {len(page)} bytes")
    p = np.frombuffer(page, kind)[0]
    if p["count"] > len(p["ids"]) or (page_id is not None and p["page_id"] != page_id):
        raise ValueError(f"the head of page {page_id} is damaged")
    out = []
    for slot in range(int(p["count"])):
        n = int(p["degrees"][slot])
        out.append((slot, int(p["ids"][slot]), p["v"][slot].tolist(), [x for x in p["nbrs"][slot][:n].tolist() if x != NONE], p["codes"][slot][:n].tobytes()))
    return out


def decode(pages: DataFrame, dim: int, degree: int, page_size: int = 4096, code_bytes: int = 0, slots: int | None = None) -> DataFrame:
    """page_id, slot, id, v, nbrs, codes."""
    kind = layout(dim, degree, page_size, code_bytes, slots)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *node) for i, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for node in decode_page(page, kind, i)]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "slot", "id", "v", "nbrs", "codes"])

    return pages.select(F.col("page_id").cast("long"), "page").mapInArrow(kernel, "page_id long, slot int, id long, v array<float>, nbrs array<long>, codes binary")


def find(pages: DataFrame, page_id: int, node_id: int, **shape) -> tuple:
    """A node of a page: one page is read. A node that isn't there is an error."""
    got = decode(pages.where(F.col("page_id") == page_id), **shape).where(F.col("id") == node_id).head()
    if got is None:
        raise ValueError(f"no node {node_id} in page {page_id}")
    return got


def encode_records(nodes: DataFrame, code_bytes: int = 0) -> DataFrame:
    """nodes: id, v, nbrs, and with code_bytes, codes. Gives id, record: RECORD_BYTES each."""

    def record(r: dict) -> bytes:
        v, nbrs, codes = np.asarray(r["v"], "<f4").tobytes(), np.asarray(r["nbrs"] or [], "<u4").tobytes(), r["codes"] or b""
        body = v + nbrs + codes
        if len(body) + HEAD.itemsize > RECORD_BYTES or len(codes) != len(nbrs) // 4 * code_bytes:
            raise ValueError(f"node {r['id']} doesn't fit in a record")
        head = np.zeros((), HEAD)
        for name, value in (("magic", MAGIC), ("node_id", r["id"]), ("degree", len(nbrs) // 4), ("dim", len(v) // 4), ("code_bytes", code_bytes), ("checksum", fnv1a(np.frombuffer(body, np.uint8)[None])[0]), ("vector_offset", HEAD.itemsize), ("neighbors_offset", HEAD.itemsize + len(v)), ("payload_bytes", HEAD.itemsize + len(body))):
            head[name] = value
        return (head.tobytes() + body).ljust(RECORD_BYTES, b"\0")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([record(r) for r in b.to_pylist()], pa.binary())], ["id", "record"])

    codes = F.col("codes") if code_bytes else F.lit(None).cast("binary")
    return nodes.select(F.col("id").cast("long"), F.col("v").cast("array<float>"), F.col("nbrs").cast("array<long>"), codes.alias("codes")).mapInArrow(kernel, "id long, record binary")


def decode_record(record: bytes) -> tuple[int, list[float], list[int], bytes]:
    """id, vector, neighbours, codes. A record without its mark, of an impossible shape or another checksum is damaged."""
    head = np.frombuffer(record, HEAD, 1)[0] if len(record) == RECORD_BYTES else None
    if head is None or head["magic"] != MAGIC:
        raise ValueError("not a record")
    dim, degree, code = (int(head[n]) for n in ("dim", "degree", "code_bytes"))
    a, b, c = HEAD.itemsize, HEAD.itemsize + 4 * dim, HEAD.itemsize + 4 * dim + 4 * degree
    end = c + degree * code
    if end > RECORD_BYTES or (head["vector_offset"], head["neighbors_offset"], head["payload_bytes"]) != (a, b, end):
        raise ValueError("a record of an impossible shape")
    if fnv1a(np.frombuffer(record[a:end], np.uint8)[None])[0] != head["checksum"]:
        raise ValueError(f"record {head['node_id']} is damaged")
    return int(head["node_id"]), np.frombuffer(record[a:b], "<f4").tolist(), np.frombuffer(record[b:c], "<u4").tolist(), record[c:end]


def decode_records(records: DataFrame) -> DataFrame:
    """id, v, nbrs, codes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.float32()), pa.list_(pa.int64()), pa.binary()]
        for b in batches:
            columns = list(zip(*map(decode_record, b.column(0).to_pylist()))) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "v", "nbrs", "codes"])

    return records.select("record").mapInArrow(kernel, "id long, v array<float>, nbrs array<long>, codes binary")
