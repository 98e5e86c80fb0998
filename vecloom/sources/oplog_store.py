"""An op log on disk: Parquet tables, and a manifest that names those which count.

A write first adds a table under a fresh name and then a manifest of the next number, by a rename to a name that was not
there. The manifest of the highest number counts, so whoever reads sees the old or the new state; tables of writes that never
committed are not named and are ignored. Any Hadoop file system will do. Rows carry a checksum; damaged ones are left out.

Batches become tables at once. Single writes (put) go to a binary log of their own and into a memory table, which becomes a
table when it reaches flush_bytes; whoever opens the store replays logs that no table holds yet, each up to its first damage.
Compaction leaves the tables it has read for one more compaction, so reads that began before can end.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from vecloom.operators import oplog
from vecloom.sources import log_files


@dataclass
class Manifest:
    version: int = 1
    next_sequence: int = 1
    next_table: int = 1
    tables: list[dict] = field(default_factory=list)  # id, level, path
    retired: list[str] = field(default_factory=list)  # paths that the next compaction removes


class OplogStore:
    """One writer at a time; readers need no lock."""

    def __init__(self, spark: SparkSession, path: str, flush_bytes: int = 64 << 20):
        self.spark, self.path, self.closed, self.flush_bytes = spark, path.rstrip("/"), False, flush_bytes
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.manifest = self._load()
        self.memory: dict[int, tuple] = {}  # the newest row of each node that no table holds yet
        self.memory_bytes = 0
        if self._logs():
            late = log_files.read(spark, f"{self.path}/wal-*").where(F.col("seq") >= self.manifest.next_sequence)
            for r in late.orderBy("seq").toLocalIterator():  # some flush_bytes at most
                self._remember(tuple(r))

    def _logs(self) -> list:
        return [s.getPath() for s in self._fs.listStatus(self._at("")) if s.getPath().getName().startswith("wal-")] if self._fs.exists(self._at("")) else []

    def _remember(self, row: tuple) -> None:
        """row: as oplog.FIELDS. It counts if it is newer than what is held of its node."""
        old = self.memory.get(row[1])
        if old is None or old[0] < row[0]:
            self.memory_bytes += oplog.record_bytes(row[3], row[4]) - (oplog.record_bytes(old[3], old[4]) if old else 0)
            self.memory[row[1]] = row
        self.manifest.next_sequence = max(self.manifest.next_sequence, row[0] + 1)

    def put(self, ops: list[tuple]) -> int:
        """Writes (node_id, v, nbrs, deleted), each with the next sequence; vectors are kept as 32-bit floats. They are in a log when this returns."""
        self._open()
        first = self.manifest.next_sequence
        rows = [(first + i, n, len(v or ()), None if v is None else np.asarray(v, np.float32).astype(float).tolist(), nbrs, deleted) for i, (n, v, nbrs, deleted) in enumerate(ops)]
        log_files.write(self.spark, log_files.encode(dict(zip(oplog.FIELDS, r)) for r in rows), f"{self.path}/wal-{first:020d}")
        for r in rows:
            self._remember(r)
        if self.memory_bytes >= self.flush_bytes:
            self.flush()
        return self.manifest.next_sequence - 1

    def flush(self) -> bool:
        """Makes the memory table a table and drops the logs it came from. Whether there was anything to flush."""
        self._open()
        logs = self._logs()
        if self.memory:
            self.manifest.tables.append(self._add(self._held(), 0))
            self._commit()
        some = bool(self.memory)
        self.memory, self.memory_bytes = {}, 0
        for path in logs:
            self._fs.delete(path, False)
        return some

    def _held(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.memory.values()), oplog.SCHEMA)

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _names(self) -> list[str]:
        """Manifests, the newest last."""
        if not self._fs.exists(self._at("")):
            return []
        return sorted(n for s in self._fs.listStatus(self._at("")) if (n := s.getPath().getName()).startswith("manifest-") and n.endswith(".json"))

    def _load(self) -> Manifest:
        names = self._names()
        if not names:
            return Manifest()
        found = json.loads(self.spark.read.text(f"{self.path}/{names[-1]}", wholetext=True).head()[0])
        if found.get("version") != 1:
            raise ValueError(f"manifest of version {found.get('version')}")
        return Manifest(**found)

    def _commit(self) -> None:
        names = self._names()
        number = int(names[-1][9:17]) + 1 if names else 1
        draft = self._at(f"draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(asdict(self.manifest)).encode()))
        out.close()
        if not self._fs.rename(draft, self._at(f"manifest-{number:08d}.json")):
            raise OSError("another writer has committed")
        for name in names[:-1]:  # the one before stays for readers
            self._fs.delete(self._at(name), False)

    def _add(self, rows: DataFrame, level: int) -> dict:
        name = f"L{level}-{self.manifest.next_table:06d}-{uuid.uuid4().hex[:8]}"
        oplog.with_checksum(rows.select(*oplog.FIELDS)).sortWithinPartitions("node_id", "seq").write.parquet(f"{self.path}/{name}")
        self.manifest.next_table += 1
        return {"id": self.manifest.next_table - 1, "level": level, "path": name}

    def append(self, ops: DataFrame) -> int:
        """Adds operations (node_id, v, nbrs, deleted, and order) in that order; gives the last sequence. Rows that carry a seq keep it, if it is beyond all before."""
        self._open()
        self.flush()
        staged = None
        if "seq" in ops.columns:
            first = ops.agg(F.min("seq")).head()[0]
            if first is not None and first < self.manifest.next_sequence:
                raise ValueError(f"sequence {first} was given before")
            rows = ops
        else:
            # Positions without a global sort: partitions are ranges of `order`, written with their places; counts by partition add up to offsets.
            staged = f"{self.path}/staged-{uuid.uuid4().hex}"
            ops.repartitionByRange("order").sortWithinPartitions("order").withColumn("place", F.monotonically_increasing_id()).write.parquet(staged)
            placed = self.spark.read.parquet(staged).withColumn("part", F.shiftright("place", 33))
            counts = sorted(placed.groupBy("part").count().collect())  # one row for each partition
            starts = [(r["part"], self.manifest.next_sequence + sum(c["count"] for c in counts[:i])) for i, r in enumerate(counts)]
            offsets = F.broadcast(self.spark.createDataFrame(starts, "part long, start long"))
            rows = placed.join(offsets, "part").withColumn("seq", F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1))
        rows = rows.select(F.col("seq").cast("long"), F.col("node_id").cast("long"), F.coalesce(F.size("v"), F.lit(0)).alias("dim"), F.col("v").cast("array<double>").alias("v"), F.col("nbrs").cast("array<long>").alias("nbrs"), F.col("deleted").cast("boolean"))
        table = self._add(rows, 0)
        if staged:
            self._fs.delete(self._at(staged.rpartition("/")[2]), True)
        last = self.spark.read.parquet(f"{self.path}/{table['path']}").agg(F.max("seq")).head()[0]
        if last is not None:
            self.manifest.tables.append(table)
            self.manifest.next_sequence = last + 1
            self._commit()
        return self.manifest.next_sequence - 1

    def log(self) -> DataFrame:
        """All versions held, in tables and in memory."""
        if self.closed or not (self.manifest.tables or self.memory):
            return self.spark.createDataFrame([], oplog.SCHEMA)
        if not self.manifest.tables:
            return self._held()
        tables = self.spark.read.schema(f"{oplog.SCHEMA}, checksum long").parquet(*(f"{self.path}/{t['path']}" for t in self.manifest.tables))
        return oplog.intact(tables).unionByName(self._held()) if self.memory else oplog.intact(tables)

    def compact(self, retain_from: int | None = None) -> dict:
        """All tables become one of level 1. Only the newest version of each node stays, and with retain_from every version from that sequence on and the newest before it. Nothing happens under two tables."""
        self._open()
        self.flush()
        if len(self.manifest.tables) < 2:
            return {"tables_in": len(self.manifest.tables), "records_in": 0, "records_out": 0}
        log = self.log()
        kept = oplog.latest(log) if retain_from is None else oplog.latest_at(log, retain_from - 1).unionByName(log.where(F.col("seq") >= retain_from))
        before, old, gone = log.count(), list(self.manifest.tables), self.manifest.retired
        table = self._add(kept, 1)
        self.manifest.tables, self.manifest.retired = [table], [t["path"] for t in old]
        self._commit()
        for path in gone:
            self._fs.delete(self._at(path), True)
        return {"tables_in": len(old), "records_in": before, "records_out": self.log().count()}

    def disk_bytes(self) -> int:
        """What the store's folder takes."""
        return self._fs.getContentSummary(self._at("")).getLength() if self._fs.exists(self._at("")) else 0

    def _open(self) -> None:
        if self.closed:
            raise ValueError("the store is closed")

    def close(self) -> None:
        """Later reads give nothing, later writes fail."""
        self.closed = True
