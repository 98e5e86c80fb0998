"""One entry to everything: a base index, a log of changes, and searches that see both."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecloom.operators import entries, ivf, knn, oplog, pq
from vecloom.operators.graph import index
from vecloom.plans.config import EngineConfig
from vecloom.sources.oplog_store import OplogStore

OPS = "order long, node_id long, v array<double>, nbrs array<long>, deleted boolean"


@dataclass
class Result:
    """Hits (qid, id, dist, rk), the sequence they are as of, and how long each stage took to plan."""

    hits: DataFrame
    read_sequence: int
    timings: dict[str, float]


class Engine:
    """base: id, v. Changes need a store; without one the base alone is searched."""

    def __init__(self, spark: SparkSession, base: DataFrame, config: EngineConfig | None = None, store: OplogStore | None = None):
        self.spark, self.config, self.store = spark, config or EngineConfig(), store
        self.base = base.select(F.col("id").cast("long"), F.col("v").cast("array<double>").alias("v"))
        if store:
            store.flush_bytes = self.config.flush_bytes
        c, self.book, self.entries = self.config, None, []
        if c.mode in ("pq", "graph"):
            self.book = pq.fit(self.base, c.pq.subspaces, c.pq.centroids, c.pq.train_limit, c.pq.iterations, c.pq.seed)
        if c.mode == "pq":
            self.codes = pq.encode(self.base, self.book)
        elif c.mode == "graph":
            self.graph = index.vamana(self.base, c.graph)
            self.entries = entries.select(self.base, None, "even", c.search.entries)
        elif c.mode == "ivf":
            self.cells = ivf.IvfFlat.build(self.base, c.cells)

    def _base_top(self, queries: DataFrame, k: int) -> DataFrame:
        s = self.config.search
        if self.config.mode == "pq":
            return pq.search(self.base, self.codes, queries, self.book, k, max(k, s.rerank))
        if self.config.mode == "graph":
            return index.search(self.graph, queries, k, s.width, s.beam, s.rerank, self.book if s.rerank else None, self.entries, **s.stops())
        if self.config.mode == "ivf":
            return self.cells.search(queries, k, s.nprobe)
        return knn.exact(self.base, queries, k, self.config.dim)

    def sequence(self) -> int:
        return self.store.manifest.next_sequence - 1 if self.store else 0

    def search_batch(self, queries: DataFrame, k: int | None = None, sequence: int | None = None) -> Result:
        """Queries: qid, qv. The sequence is taken first; base hits are corrected by what was written up to it."""
        k = self.config.search.k if k is None else k
        seq, took, began = self.sequence() if sequence is None else sequence, {}, time.perf_counter()
        top = self._base_top(queries, k)
        took["base"], began = time.perf_counter() - began, time.perf_counter()
        if self.store and seq:
            top = oplog.merged_topk(self.base, self.store.log(), queries, k, seq, self.config.dim, base_top=top)
            took["merge"] = time.perf_counter() - began
        return Result(top, seq, took)

    def search(self, vector: list[float], k: int | None = None) -> list[tuple[int, float]]:
        q = self.spark.createDataFrame([(0, [float(x) for x in vector])], "qid long, qv array<double>")
        return [(r["id"], r["dist"]) for r in self.search_batch(q, k).hits.orderBy("rk").collect()]

    def search_as_of(self, reads: DataFrame, k: int | None = None) -> DataFrame:
        """reads: qid, qv, at. Many reads, each as of its own sequence: the base's hits without what was overwritten by then, and what was written."""
        k = self.config.search.k if k is None else k
        top = knn.for_each(reads, lambda q: self._base_top(q, k), self.config.dim)
        return oplog.merged_as_of(self.base, self.store.log(), reads, k, self.config.dim, base_top=top) if self.store else top

    def truth_as_of(self, reads: DataFrame, k: int) -> DataFrame:
        return oplog.exact_as_of(self.base, self.store.log() if self.store else self.spark.createDataFrame([], oplog.SCHEMA), reads, k, self.config.dim)

    def truth(self, queries: DataFrame, k: int, sequence: int | None = None) -> DataFrame:
        """The exact result over all that is live."""
        seq = self.sequence() if sequence is None else sequence
        return oplog.exact_topk(self.base, self.store.log(), queries, k, seq, self.config.dim) if self.store and seq else knn.exact(self.base, queries, k, self.config.dim)

    def _write(self, rows: list[tuple]) -> int:
        if not self.store:
            raise ValueError("changes need a store")
        return self.store.put(rows)

    def insert(self, node_id: int, vector: list[float], neighbors: list[int] | None = None) -> int:
        """Writes a vector, new or not; gives its sequence."""
        if len(vector) != self.config.dim:
            raise ValueError(f"dimension {len(vector)} instead of {self.config.dim}")
        return self._write([(node_id, [float(x) for x in vector], neighbors, False)])

    update = insert

    def erase(self, node_id: int) -> int:
        return self._write([(node_id, None, None, True)])

    def write_batch(self, ops: DataFrame) -> int:
        """Many changes at once: order, node_id, v, nbrs, deleted."""
        if not self.store:
            raise ValueError("changes need a store")
        return self.store.append(ops)

    def memory_bytes(self) -> int:
        """What a memtable of the whole log would take."""
        return oplog.memtable(self.store.log()).agg(F.coalesce(F.sum("bytes"), F.lit(0))).head()[0] if self.store else 0

    def flush(self) -> bool:
        """Makes single writes a table. Whether there were any."""
        if not self.store:
            raise ValueError("changes need a store")
        return self.store.flush()

    def compact(self, retain_from: int | None = None) -> dict:
        if not self.store:
            raise ValueError("changes need a store")
        return self.store.compact(retain_from)

    def close(self) -> None:
        if self.store:
            self.store.close()
