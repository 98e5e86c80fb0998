"""fvecs and ivecs as Spark data sources: records of an int32 count and that many values, little endian.

spark.read.format("fvecs").load(path) gives (id, v); "ivecs" gives (id, v) with whole numbers. Partitions are byte ranges that
are read in parallel: fvecs records all have one size, and of ivecs records the driver walks over the heads.
These read through Python's open(), as files on a mounted path. read() takes paths of any Hadoop file system: local ones go
this way, fvecs elsewhere are read in parallel as records of fixed length, and ivecs elsewhere as whole files.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_DIM = 1_000_000
SPLIT = 64 << 20
SCHEMAS = {"fvecs": "id long, v array<float>", "ivecs": "id long, v array<long>"}


class Range(InputPartition):
    def __init__(self, first: int, count: int, at: int = 0):
        """at: the byte where it begins, for records of differing sizes."""
        self.first, self.count, self.at = first, count, at


def parse(data: bytes, kind: str, name: str = "data") -> list[np.ndarray]:
    """All records of a buffer; all fvecs records must have one dimension."""
    out, i, dim = [], 0, None
    while i < len(data):
        if i + 4 > len(data):
            raise ValueError(f"{name} is cut off at byte {i}")
        n = struct.unpack_from("<i", data, i)[0]
        if not 1 <= n <= MOST_DIM:
            raise ValueError(f"{name}: a dimension of {n} at byte {i}")
        if kind == "fvecs" and n != (dim := dim or n):
            raise ValueError(f"{name}: dimensions {dim} and {n}")
        if i + 4 + 4 * n > len(data):
            raise ValueError(f"{name} is cut off at byte {i}")
        out.append(np.frombuffer(data, "<f4" if kind == "fvecs" else "<u4", n, i + 4))
        i += 4 + 4 * n
    return out


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.path = kind, options["path"].removeprefix("file://")
        self.offset, self.limit = int(options.get("offset", 0)), int(options.get("limit", -1))
        if self.offset < 0:
            raise ValueError("offset must not be negative")

    def partitions(self) -> list[InputPartition]:
        if self.kind == "ivecs":
            return self._walk()
        size = os.path.getsize(self.path)
        if not size:
            return [Range(0, 0)]
        with open(self.path, "rb") as f:
            head = f.read(4)
        dim = struct.unpack("<i", head)[0] if len(head) == 4 else 0
        if not 1 <= dim <= MOST_DIM or size % (4 + 4 * dim):
            raise ValueError(f"{self.path} isn't a whole number of records of dimension {dim}")
        end = size // (4 + 4 * dim)
        if self.limit >= 0:
            end = min(end, self.offset + self.limit)
        step = max(1, SPLIT // (4 + 4 * dim))
        return [Range(i, min(step, end - i)) for i in range(self.offset, end, step)] or [Range(0, 0)]

    def _walk(self) -> list[InputPartition]:
        """Ranges of some SPLIT bytes, from the records' heads."""
        out, size, i, at = [Range(0, 0)], os.path.getsize(self.path), 0, 0
        with open(self.path, "rb") as f:
            while at < size and (self.limit < 0 or i < self.offset + self.limit):
                f.seek(at)
                head = f.read(4)
                n = struct.unpack("<i", head)[0] if len(head) == 4 else -1
                if not 0 <= n <= MOST_DIM or at + 4 + 4 * n > size:
                    raise ValueError(f"{self.path} is cut off in record {i}")
                if i >= self.offset:
                    if not out[-1].count or at - out[-1].at >= SPLIT:
                        out.append(Range(i, 0, at))
                    out[-1].count += 1
                i, at = i + 1, at + 4 + 4 * n
        return out[1:] or out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if self.kind == "fvecs":
            with open(self.path, "rb") as f:
                head = f.read(4)
                if not head or not part.count:
                    return
                stride = 4 + 4 * struct.unpack("<i", head)[0]
                for i in range(part.first, part.first + part.count, 10_000):
                    n = min(10_000, part.first + part.count - i)
                    f.seek(i * stride)
                    rows = np.frombuffer(f.read(n * stride), "<i4").reshape(n, -1)
                    if (rows[:, 0] != rows.shape[1] - 1).any():
                        raise ValueError(f"{self.path}: dimensions differ")
                    flat = rows[:, 1:].copy().view("<f4").ravel()
                    v = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, rows.shape[1] - 1, dtype=np.int32), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + n)), v], ["id", "v"])
            return
        with open(self.path, "rb") as f:
            f.seek(part.at)
            for i in range(part.first, part.first + part.count, 10_000):
                ids = range(i, min(i + 10_000, part.first + part.count))
                rows = [np.frombuffer(f.read(4 * struct.unpack("<i", f.read(4))[0]), "<u4").astype(np.int64) for _ in ids]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["id", "v"])


class FvecsSource(DataSource):
    kind = "fvecs"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return SCHEMAS[self.kind]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.kind, self.options)


class IvecsSource(FvecsSource):
    kind = "ivecs"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)


def read(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """id, v of a file on any file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        register(spark)
        return spark.read.format(kind).load(path)
    if kind == "ivecs":
        return from_binary(spark, path, kind).select(F.col("pos").alias("id"), F.col("v").cast("array<long>").alias("v"))
    stream = fs.open(where)
    head = bytes(x & 255 for x in (stream.read(), stream.read(), stream.read(), stream.read()))
    stream.close()
    dim = struct.unpack("<i", head)[0]
    if not 1 <= dim <= MOST_DIM or fs.getFileStatus(where).getLen() % (4 + 4 * dim):
        raise ValueError(f"{path} isn't a whole number of records of dimension {dim}")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(b.num_rows, dim + 1)
            if (rows[:, 0] != dim).any():
                raise ValueError(f"{path}: dimensions differ")
            v = pa.ListArray.from_arrays(np.arange(0, b.num_rows * dim + 1, dim, dtype=np.int32), pa.array(rows[:, 1:].copy().view("<f4").ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), v], ["id", "v"])

    # Records of fixed length, split by Hadoop's own reader: the one place where rows come as an RDD.
    records = spark.sparkContext.binaryRecords(path, 4 + 4 * dim).zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))
    return spark.createDataFrame(records, "id long, record binary").mapInArrow(vectors, SCHEMAS["fvecs"])


def encode(rows, kind: str = "fvecs") -> bytes:
    return b"".join(struct.pack("<i", len(r)) + np.asarray(r, "<f4" if kind == "fvecs" else "<u4").tobytes() for r in rows)


def from_binary(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """Whole files through Spark's own reader, from any store: file, pos, v. For files that fit in a task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = parse(data.as_py(), kind, name)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array([r.astype(float) for r in rows], pa.list_(pa.float64()))], ["file", "pos", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(kernel, "file string, pos long, v array<double>")
