"""What the operators share: the shared work folder, written intermediate tables, column access."""

from __future__ import annotations

import atexit
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vecloom.sources.scratch import fresh

_written: list[tuple[SparkSession, str, str]] = []
_owner = [""]


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder. It is removed when the driver ends, or by release()."""
    path = fresh(spark, tag)
    _written.append((spark, path, _owner[0]))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def owned(name: str) -> Iterator[None]:
    """Tables written inside are freed by release(name)."""
    before, _owner[0] = _owner[0], name
    try:
        yield
    finally:
        _owner[0] = before


def release(owner: str | None = None) -> None:
    """Removes the intermediate tables of an owner, or all; their DataFrames can't be read afterwards."""
    left = [w for w in _written if owner is not None and w[2] != owner]
    gone = [w for w in _written if owner is None or w[2] == owner]
    _written[:] = left
    for spark, path, _ in gone:
        remove(spark, path)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the session has ended: the cluster's own cleaning takes over
        return


#: Whether a finished query's shuffle files go at once, or when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: Intermediate tables on a mounted folder go without the side files of checksums, each of which would cost the executor
#: a child process that sets its permissions; Parquet pages have checksums of their own. Other file systems don't see this.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}


def materialize(df: DataFrame, tag: str, even: bool = False) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it back. It outlives lost executors. With `even`, many small parts become few."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    with cleaning(spark):
        (df.hint("rebalance") if even else df).write.options(**PLAIN).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, text_col: str, carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """The carried columns (all by default) named c0, c1, ..., so that nothing clashes, and the name of the one that holds the text as a string."""
    carry = docs.columns if carry is None else carry
    columns = [at(c).alias(f"c{i}") for i, c in enumerate(carry)]
    if text_col in carry and isinstance(docs.schema[text_col].dataType, T.StringType):
        return docs.select(*columns), f"c{carry.index(text_col)}"
    return docs.select(*columns, at(text_col).cast("string").alias("t")), "t"


def named(df: DataFrame, carry: list[str], *more: str | Column) -> DataFrame:
    """The carried columns under their own names, of a table that came from numbered()."""
    return df.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), *more)


def appended(schema: T.StructType, added: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(added).fields])


def append(part: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, *columns.values()], [*part.schema.names, *columns])


def groups(batches: Iterable[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in their first `by` columns, which are longs."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not len(t):
            continue
        keys = np.stack([c.to_numpy() for c in t.columns[:by]])
        cuts = np.nonzero((keys[:, 1:] != keys[:, :-1]).any(0))[0] + 1
        first = keys[:, 0].tolist()
        if held and [c[-1].as_py() for c in held[-1].columns[:by]] != first:
            yield pa.concat_tables(held)
            held = []
        edges = [0, *cuts.tolist(), len(t)]
        for a, z in zip(edges[:-2], edges[1:-1]):
            yield pa.concat_tables([*held, t.slice(a, z - a)])
            held = []
        held.append(t.slice(edges[-2]))
    if held:
        yield pa.concat_tables(held)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts an Arrow batch so that each part holds about max_bytes of the column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > max_bytes:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def texts(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each part of the batches with its texts; null reads as empty."""
    for batch in batches:
        for part in slices(batch, column):
            yield part, [x or "" for x in part.column(column).to_pylist()]
        pa.default_memory_pool().release_unused()
