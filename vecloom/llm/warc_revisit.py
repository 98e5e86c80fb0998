"""WARC archives and revisit resolution.

write_responses() turns pages into response records. resolve() reads archives, shuffles headers by payload digest, and takes
as original the response with the largest page id; the other records of a payload become revisits that refer to it, and
deduplicated archives are written with fresh headers. read() gives the records of archives.

Payloads are never shuffled, at any size: revisits are written from the joined headers alone, as they have no payload, and
originals by the tasks that read them, which need no more than a bit for each record that tells whether it stays. These bits
are broadcast by file, for so many files at a time that they are BITS_BYTES at most; each file is read in one such pass.
A record is known by its file and its place there, so archives may share record ids, or be there twice.

Archives are written by Spark's own text writer: a value is a bundle of records of some BUNDLE_BYTES (or one larger record),
and the two line ends behind each record are the line separator. So files appear only when a task commits, on any file
system Spark can write. They are compressed as gzip and hold at most BUNDLES_PER_FILE bundles, as a file is read whole by
one Python worker and cut by Content-Length, so payloads may hold anything. Record ids come from the write, task and row.

Defined cases: a null html is an empty payload, and empty payloads are equal like any others; a very long html is one record;
of repeated page ids with equal payloads one is the response; a page without an id, or with one that is no whole number,
counts as smaller than any other and has none; a null url is written as about:blank; control characters in urls are
percent-encoded; an empty table gives an empty archive and result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import count
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from vecloom.llm.common import at, materialize, remove, scratch, texts

#: Fixed values of the format.
VERSION, END, BETWEEN = "WARC/1.1", "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
BUNDLE_BYTES, BUNDLES_PER_FILE = 512 << 10, 64
BITS_BYTES = 8 << 20
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes | memoryview) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: dict[str, str | int | None], block: str = "", block_bytes: int | None = None) -> str:
    """A record without the line ends behind it."""
    size = len(block.encode("utf-8", "surrogatepass")) if block_bytes is None else block_bytes
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {size}"]
    return END.join(lines) + BETWEEN + block


def _clean(url: str | None) -> str:
    return UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def response(rid: str, page_id: int | None, url: str | None, html: str, size: int, sha: str) -> str:
    head = HTTP.format(size)
    headers = {
        "WARC-Record-ID": rid,
        "WARC-Date": DATE,
        "WARC-Target-URI": _clean(url),
        "WARC-Payload-Digest": f"sha1:{sha}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": page_id,
        "X-Payload-Length": size,
    }
    return record("response", headers, head + html, len(head) + size)


def revisit(rid: str, page_id: int | None, url: str, size: int, sha: str, original: str, original_page: int | None, original_url: str) -> str:
    headers = {
        "WARC-Record-ID": rid,
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{sha}",
        "WARC-Profile": PROFILE,
        "WARC-Refers-To": original,
        "WARC-Refers-To-Target-URI": original_url,
        "WARC-Refers-To-Date": DATE,
        "WARC-Truncated": "length",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": page_id,
        "X-Payload-Length": size,
        "X-Refers-To-Page-ID": original_page,
    }
    return record("revisit", headers, HTTP.format(size))


def _save(records: DataFrame, path: str, bundles: int = BUNDLES_PER_FILE) -> None:
    """records: one string column of bundles."""
    records.write.mode("append").options(lineSep=BETWEEN, compression="gzip", maxRecordsPerFile=bundles).option("zlib.compress.level", "BEST_SPEED").text(path)


def _bundled(records: Iterable[str], most: int = BUNDLE_BYTES) -> Iterator[pa.RecordBatch]:
    held: list[str] = []
    size = 0
    for x in records:
        held.append(x)
        size += len(x)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array([BETWEEN.join(held)], pa.string())], ["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([BETWEEN.join(held)], pa.string())], ["value"])


def write_responses(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bundle_bytes: int = BUNDLE_BYTES, bundles: int = BUNDLES_PER_FILE) -> None:
    """One response record for each page, as gzip archives in the folder `path`."""
    space = uuid.uuid4()  # of this write

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, numbers = TaskContext.get().partitionId(), count()

        def records() -> Iterator[str]:
            for part, values in texts(batches, "html"):
                for page_id, url, html in zip(part.column("page").to_pylist(), part.column("url").to_pylist(), values, strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    yield response(f"<{uuid.uuid5(space, f'{where}/{next(numbers)}').urn}>", page_id, url, html, len(payload), digest(payload))

        yield from _bundled(records(), bundle_bytes)

    page = at(id_col).try_cast("long")
    slim = pages.select(page.alias("page"), at(url_col).cast("string").alias("url"), at(html_col).cast("string").alias("html"))
    _save(slim.mapInArrow(kernel, "value string"), path, bundles)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and block of each record of an archive."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    view, i = memoryview(data), 0
    while i < len(data):
        j = data.find(b"\r\n\r\n", i)
        lines = data[i : max(i, j)].decode("utf-8", "surrogatepass").split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {i}: {data[i : i + 40]!r}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin, end = j + 4, j + 4 + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {i} doesn't end after its length")
        yield headers, view[begin:end]
        i = end + 4


HEADERS = "file string, place int, rid string, page long, url string, type string, digest string, size long, original string, original_page long"


def _records(content: bytes) -> Iterator[tuple[tuple, memoryview | None]]:
    """Of each record what HEADERS names behind the place, and a response's payload. Payloads' digests are checked."""
    for h, block in parse(content):
        page, original = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
        sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
        body = None
        if h["WARC-Type"] == "response":
            body = block[bytes(block[: 1 << 16]).index(b"\r\n\r\n") + 4 :]
            if digest(body) != sha:
                raise ValueError(f"payload of {h['WARC-Record-ID']} doesn't have its digest")
        yield (h["WARC-Record-ID"], None if page is None else int(page), h["WARC-Target-URI"], h["WARC-Type"], sha, int(h["X-Payload-Length"]), h.get("WARC-Refers-To"), None if original is None else int(original)), body


def _text(body: memoryview) -> str:
    return bytes(body).decode("utf-8", "surrogatepass")


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(list(paths)).select(F.col("path").alias("file"), "content")


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of archives: their headers, and on demand the payload. A payload's digest is checked."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = ["file", "place", "rid", "page", "url", "type", "digest", "size", "original", "original_page", "payload"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(kinds)
            keep = len(kinds) if payload else len(kinds) - 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:keep], kinds)], names[:keep])

        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, held = [], 0
                for place, (head, body) in enumerate(_records(content.as_py())):
                    rows.append((file, place, *head, _text(body) if payload and body is not None else None))
                    held += len(body) if payload and body is not None else 0
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    return _files(spark, path).mapInArrow(kernel, HEADERS + (", payload string" if payload else ""))


def _as_revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[str]:
        for b in batches:
            for r in b.to_pylist():
                yield revisit(r["rid"], r["page"], r["url"], r["size"], r["digest"], r["original"], r["original_page"], r["original_url"])

    yield from _bundled(records())


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file and places: a bit for each place up to the last."""
    for b in batches:
        bits = [np.packbits(np.bincount(p.values.to_numpy()).astype(bool), bitorder="little").tobytes() for p in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary())], ["file", "bits"])


def _originals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, content, bits: the records that are not marked."""

    def records() -> Iterator[str]:
        for b in batches:
            for content, bits in zip(b.column(1), b.column(2).to_pylist()):
                gone = np.unpackbits(np.frombuffer(bits or b"", np.uint8), bitorder="little")
                for place, ((rid, page, url, kind, sha, size, _, _), body) in enumerate(_records(content.as_py())):
                    if kind == "response" and not (place < len(gone) and gone[place]):
                        yield response(rid, page, url, _text(body), size, sha)

    yield from _bundled(records())


def resolve(spark: SparkSession, source: str, target: str, bits_bytes: int = BITS_BYTES) -> None:
    """Reads the archives in `source` and writes deduplicated ones to `target`."""
    headers = read(spark, source).where("type = 'response'").select("file", "place", "rid", "page", "url", "digest", "size")
    order = F.struct("page", "file", "place", "rid", "url")
    first = headers.groupBy("digest").agg(F.max(order).alias("first"), F.count(F.lit(1)).alias("n"))
    # Payloads of one record only need no second look.
    again = headers.join(first.where("n > 1"), "digest").where((F.col("file") != F.col("first.file")) | (F.col("place") != F.col("first.place")))
    again = materialize(again.select("file", "place", "rid", "page", "url", "digest", "size", F.col("first.rid").alias("original"), F.col("first.page").alias("original_page"), F.col("first.url").alias("original_url")), "revisits")
    _save(again.drop("file", "place").mapInArrow(_as_revisits, "value string"), target)
    marked = materialize(again.groupBy("file").agg(F.collect_list("place").alias("places")).mapInArrow(_bits, "file string, bits binary"), "marked")
    total = marked.agg(F.coalesce(F.sum(F.octet_length("bits") + 200), F.lit(0))).first()[0]
    passes = ceil(total / bits_bytes) or 1
    names = sorted(r[0] for r in _files(spark, source).select("file").collect()) if passes > 1 else [source]
    for i in range(passes):
        some = _files(spark, *(names if passes == 1 else names[i::passes]))
        # Broadcast of at most bits_bytes, more or less: the share of some of the files.
        mine = marked if passes == 1 else marked.join(F.broadcast(spark.createDataFrame([(n,) for n in names[i::passes]], "file string")), "file")
        _save(some.join(F.broadcast(mine), "file", "left").select("file", "content", "bits").mapInArrow(_originals, "value string"), target)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages as archives, resolves revisits, and reads the result back: id_col, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    plain, final = scratch(spark, "warc-plain"), scratch(spark, "warc")
    write_responses(pages, plain, id_col, url_col, html_col)
    resolve(spark, plain, final)
    remove(spark, plain)
    return read(spark, final).select(
        F.col("page").alias(id_col),
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", F.col("original_page")).alias("refers_to"),
        F.col("rid").alias("record_id"),
        F.col("original").alias("refers_to_record"),
    )
