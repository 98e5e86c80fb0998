"""Mixed runs of reads and writes against an engine, their results as rows, and summaries of search runs.

run() executes a given order of operations in two steps that give what one by one would: all writes go to the store with
their place in the order as sequence, then all reads are answered at once, each as of its own place. run_concurrently() has
readers and writers work at the same time, as threads that submit Spark jobs, with compaction in the background.
"""

from __future__ import annotations

import threading
import time
from dataclasses import asdict, dataclass, field, fields
from math import ceil

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecloom.operators import metrics, oplog
from vecloom.plans.engine import Engine
from vecloom.sources.scratch import fresh


def summarize(values: list[float]) -> dict[str, float]:
    """Mean and nearest-rank percentiles; zeros without values."""
    x = sorted(values)
    pick = lambda p: x[min(len(x), max(1, ceil(p * len(x)))) - 1] if x else 0.0
    return {"avg": sum(x) / len(x) if x else 0.0, "p50": pick(0.5), "p95": pick(0.95), "p99": pick(0.99), "p999": pick(0.999)}


@dataclass
class MixedResult:
    """The columns of a mixed run's row, in order."""

    scenario: str = ""
    read_ratio: float = 0.0
    write_ratio: float = 0.0
    read_threads: int = 1
    write_threads: int = 1
    duration_sec: float = 0.0
    read_ops: int = 0
    write_ops: int = 0
    read_qps: float = 0.0
    write_qps: float = 0.0
    total_qps: float = 0.0
    insert_throughput: float = 0.0
    avg_latency: float = 0.0
    p50_latency: float = 0.0
    p95_latency: float = 0.0
    p99_latency: float = 0.0
    p999_latency: float = 0.0
    read_p50: float = 0.0
    read_p95: float = 0.0
    read_p99: float = 0.0
    write_p50: float = 0.0
    write_p95: float = 0.0
    write_p99: float = 0.0
    recall_at_10: float = 1.0
    recall_samples: int = 0
    recall_sample_rate: float = 0.0
    recall_read_sequence_min: int = 0
    recall_read_sequence_max: int = 0
    exact_delta_visible_count_avg: float = 0.0
    exact_deleted_count_avg: float = 0.0
    memtable_insert_avg_us: float = 0.0
    flush_duration_ms: float = 0.0
    sstable_count: int = 0
    delta_record_count: int = 0
    memory_usage_mb: float = 0.0
    disk_usage_mb: float = 0.0
    recovery_time_ms: float = 0.0
    search_mode: str = ""
    graph_reads_per_read: float = 0.0
    cache_hit_rate: float = 0.0
    compaction_attempted: int = 0
    compaction_count: int = 0
    compaction_duration_ms: float = 0.0
    compaction_input_records: int = 0
    compaction_output_records: int = 0

    def timed(self, seconds: float, reads: list[float], writes: list[float]) -> MixedResult:
        """Latencies in milliseconds, throughputs from the counts."""
        self.duration_sec, s = seconds, max(1e-9, seconds)
        self.read_qps, self.write_qps, self.total_qps = self.read_ops / s, self.write_ops / s, (self.read_ops + self.write_ops) / s
        self.insert_throughput = self.write_qps
        for name, value in summarize([*reads, *writes]).items():
            setattr(self, f"{name}_latency", value)
        for kind, values in (("read", reads), ("write", writes)):
            for name, value in summarize(values).items():
                if name in ("p50", "p95", "p99"):
                    setattr(self, f"{kind}_{name}", value)
        self.memtable_insert_avg_us = 1000 * summarize(writes)["avg"]
        return self


def frame(spark: SparkSession, results: list[MixedResult]) -> DataFrame:
    kinds = {"str": "string", "int": "long", "float": "double"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(MixedResult))
    return spark.createDataFrame([tuple(asdict(r).values()) for r in results], schema)


def operations(ops: DataFrame, vectors: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """ops: seq, op, qid, node_id. vectors: node_id, v. The writes as an op log and the reads as (read, qid, at), both by `start` and their place."""
    writes = ops.where("op = 'write'").select((F.col("seq") + start).alias("seq"), "node_id").join(vectors, "node_id").select("seq", "node_id", "v", F.lit(None).cast("array<long>").alias("nbrs"), F.lit(False).alias("deleted"))
    return writes, ops.where("op = 'read'").select(F.col("seq").alias("read"), "qid", (F.col("seq") + start).alias("at"))


def outcome(e: Engine, reads: DataFrame, queries: DataFrame, k: int, share: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """reads: read, qid, at. Hits (qid is the read), and by sampled read: recall, at, how many versions and deleted nodes its truth sees."""
    asked = reads.join(queries, "qid").select(F.col("read").alias("qid"), "qv", "at")
    path = fresh(e.spark, "hits")  # they are read twice
    e.search_as_of(asked, k).write.parquet(path)
    hits = e.spark.read.parquet(path)
    some = metrics.sampled(asked, share, seed)
    recall = metrics.recall(hits.join(some.select("qid"), "qid", "left_semi"), e.truth_as_of(some, k), k)
    seen = visible(e.store.log() if e.store else e.spark.createDataFrame([], oplog.SCHEMA), some.select("at").distinct())
    return hits, some.select("qid", "at").join(recall, "qid").join(seen, "at")


def visible(log: DataFrame, at: DataFrame) -> DataFrame:
    """at (distinct): live and deleted nodes of the log as of each sequence, by sums over what each write changes."""
    from pyspark.sql import Window

    before = F.lag("deleted").over(Window.partitionBy("node_id").orderBy("seq"))
    each = log.select("seq", F.col("deleted").alias("now"), before.alias("was"))
    change = each.select("seq", (F.lit(1) - F.col("now").cast("int") - F.when(F.col("was"), 0).when(~F.col("was"), 1).otherwise(0)).alias("live"), (F.col("now").cast("int") - F.coalesce(F.col("was").cast("int"), F.lit(0))).alias("gone"), F.lit(None).cast("long").alias("at"))
    marks = at.select(F.col("at").alias("seq"), F.lit(0).alias("live"), F.lit(0).alias("gone"), "at")
    # Sums in two steps: over blocks of sequences, and within each.
    every = change.unionByName(marks).withColumn("block", F.shiftright("seq", 14))
    sums = every.groupBy("block").agg(F.sum("live").alias("live"), F.sum("gone").alias("gone"))
    w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("block", F.coalesce(F.sum("live").over(w), F.lit(0)).alias("live0"), F.coalesce(F.sum("gone").over(w), F.lit(0)).alias("gone0"))
    inside = Window.partitionBy("block").orderBy("seq", F.col("at").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = every.withColumn("live", F.sum("live").over(inside)).withColumn("gone", F.sum("gone").over(inside)).where("at is not null")
    return out.join(base, "block").select("at", (F.col("live") + F.col("live0")).alias("visible"), (F.col("gone") + F.col("gone0")).alias("deleted"))


def run(e: Engine, ops: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 10, scenario: str = "custom", share: float = 1.0, compact: bool = False, path: str | None = None) -> MixedResult:
    """Executes ops (seq, op, qid, node_id) in their order; vectors (node_id, v) are what writes write."""
    out = MixedResult(scenario, search_mode=e.config.mode, recall_sample_rate=share)
    start, began = e.sequence(), time.perf_counter()
    writes, reads = operations(ops, vectors, start)
    counts = {r["op"]: r["count"] for r in ops.groupBy("op").count().collect()}
    out.read_ops, out.write_ops = counts.get("read", 0), counts.get("write", 0)
    total = max(1, out.read_ops + out.write_ops)
    out.read_ratio, out.write_ratio = out.read_ops / total, out.write_ops / total
    t = time.perf_counter()
    if out.write_ops:
        e.store.append(writes)
    write_ms = 1000 * (time.perf_counter() - t)
    t = time.perf_counter()
    hits, sampled = outcome(e, reads, queries, k, share)
    hits.write.format("noop").mode("overwrite").save()
    read_ms = 1000 * (time.perf_counter() - t)
    seconds = time.perf_counter() - began
    s = sampled.agg(F.avg("recall").alias("r"), F.count(F.lit(1)).alias("n"), F.min("at").alias("a"), F.max("at").alias("z"), F.avg("visible").alias("v"), F.avg("deleted").alias("d")).head()
    if s["n"]:
        out.recall_at_10, out.recall_samples, out.recall_read_sequence_min, out.recall_read_sequence_max = s["r"], s["n"], s["a"], s["z"]
        out.exact_delta_visible_count_avg, out.exact_deleted_count_avg = s["v"], s["d"]
    # One batch each: an operation takes its share.
    out.timed(seconds, [read_ms / out.read_ops] * out.read_ops if out.read_ops else [], [write_ms / out.write_ops] * out.write_ops if out.write_ops else [])
    return _assembled(out, e, compact)


def _assembled(out: MixedResult, e: Engine, compact: bool) -> MixedResult:
    """What the store holds in the end, how long it takes to flush, compact and open again."""
    t = time.perf_counter()
    e.flush()
    out.flush_duration_ms = 1000 * (time.perf_counter() - t)
    if compact:
        t = time.perf_counter()
        done = e.compact()
        out.compaction_attempted += 1
        out.compaction_count += bool(done["records_in"])
        out.compaction_duration_ms += 1000 * (time.perf_counter() - t)
        out.compaction_input_records += done["records_in"]
        out.compaction_output_records += done["records_out"]
    log = e.store.log()
    out.sstable_count, out.delta_record_count = len(e.store.manifest.tables), log.count()
    out.memory_usage_mb = (oplog.memtable(log).agg(F.coalesce(F.sum("bytes"), F.lit(0))).head()[0]) / (1 << 20)
    out.disk_usage_mb = e.store.disk_bytes() / (1 << 20)
    t = time.perf_counter()
    type(e.store)(e.spark, e.store.path)
    out.recovery_time_ms = 1000 * (time.perf_counter() - t)
    return out


@dataclass
class _Shared:
    stop: threading.Event = field(default_factory=threading.Event)
    lock: threading.Lock = field(default_factory=threading.Lock)
    reads: list[float] = field(default_factory=list)
    writes: list[float] = field(default_factory=list)
    failed: list[BaseException] = field(default_factory=list)
    read_ops: int = 0
    write_ops: int = 0


def run_concurrently(e: Engine, queries: DataFrame, vectors: list[list[float]], first_id: int, seconds: float, readers: int = 2, k: int = 10, scenario: str = "custom", read_batch: int = 32, write_batch: int = 32, compact_every: float = 0.0) -> MixedResult:
    """Readers answer batches of queries in turn while one writer inserts `vectors` from first_id up and, if asked to, tables are compacted; until the time is over or, for the writer, all is written.

    The store takes one writer at a time: writing and compaction exclude each other, reading goes on.
    """
    shared, n = _Shared(), queries.count()
    bounds = [(a, min(a + read_batch, n)) for a in range(0, n, read_batch)]
    numbered = [r[0] for r in queries.select("qid").orderBy("qid").collect()]  # the queries of a run are few

    def guarded(work):
        def inner() -> None:
            try:
                work()
            except BaseException as x:  # noqa: BLE001  told to the caller
                shared.failed.append(x)
                shared.stop.set()

        return threading.Thread(target=inner, daemon=True)

    def read(turn: int) -> None:
        while not shared.stop.is_set():
            a, z = bounds[turn % len(bounds)]
            turn += 1
            t = time.perf_counter()
            some = queries.where(F.col("qid").between(numbered[a], numbered[z - 1]))
            e.search_batch(some, k).hits.write.format("noop").mode("overwrite").save()
            took = 1000 * (time.perf_counter() - t) / (z - a)
            with shared.lock:
                shared.reads.extend([took] * (z - a))
                shared.read_ops += z - a

    def write() -> None:
        for a in range(0, len(vectors), write_batch):
            if shared.stop.is_set():
                return
            some = vectors[a : a + write_batch]
            t = time.perf_counter()
            with writer:
                e.store.put([(first_id + a + i, v, None, False) for i, v in enumerate(some)])
            shared.writes += [1000 * (time.perf_counter() - t) / len(some)] * len(some)
            shared.write_ops += len(some)

    out = MixedResult(scenario, read_threads=readers, search_mode=e.config.mode)

    def tidy() -> None:
        while not shared.stop.wait(compact_every):
            t = time.perf_counter()
            with writer:
                done = e.compact()
            out.compaction_attempted += 1
            out.compaction_count += bool(done["records_in"])
            out.compaction_duration_ms += 1000 * (time.perf_counter() - t)
            out.compaction_input_records += done["records_in"]
            out.compaction_output_records += done["records_out"]

    writer, began = threading.Lock(), time.perf_counter()
    threads = [*(guarded(lambda i=i: read(i)) for i in range(readers if bounds else 0)), guarded(write), *([guarded(tidy)] if compact_every else [])]
    for x in threads:
        x.start()
    shared.stop.wait(seconds)
    shared.stop.set()
    for x in threads:
        x.join()
    if shared.failed:
        raise shared.failed[0]
    out.read_ops, out.write_ops = shared.read_ops, shared.write_ops
    total = max(1, out.read_ops + out.write_ops)
    out.read_ratio, out.write_ratio = out.read_ops / total, out.write_ops / total
    return _assembled(out.timed(time.perf_counter() - began, shared.reads, shared.writes), e, False)


def search_result(e: Engine, queries: DataFrame, k: int, recall: float | None = None, seconds: float | None = None, stats: dict | None = None) -> dict:
    """One search run as a result file has it: what was asked for, what was in effect, warnings, measures and counters."""
    c, n = e.config, queries.count()
    dim, base = c.dim, e.base.count()
    budget = metrics.memory_budget(base, dim, c.pq.subspaces, c.pq.centroids)
    return {
        "base_count": base, "query_count": n, "dim": dim, "top_k": k, "search_mode": c.mode,
        "search_width": c.search.width, "effective_search_width": max(c.search.width, k),
        "beam_width": c.search.beam, "effective_beam_width": c.search.beam or c.search.width,
        "entry_count": c.search.entries, "entry_seed_count": len(e.entries), "rerank": c.search.rerank, "nprobe": c.search.nprobe,
        "pq_subspaces": c.pq.subspaces, "pq_centroids": c.pq.centroids, "warnings": list(c.search.warnings),
        "recall_at_k": recall, "elapsed_ms": None if seconds is None else 1000 * seconds, "qps": None if not seconds else n / seconds,
        "avg_query_latency_ms": None if seconds is None or not n else 1000 * seconds / n,
        "resident_bytes": float(budget["resident_bytes"]), "resident_ratio": float(budget["resident_ratio"]), "stats": dict(stats or {}),
    }


def run_summary(result: dict) -> dict[str, float]:
    """The main figures of a result, counters by query."""
    n = max(1, int(result.get("query_count") or 0))
    out = {f"recall@{result.get('top_k')}": float(result.get("recall_at_k") or 0), "qps": float(result.get("qps") or 0), "avg_latency_ms": float(result.get("elapsed_ms") or 0) / n, "measured_avg_query_latency_ms": float(result.get("avg_query_latency_ms") or 0)}
    counters = ("submitted_reads", "demand_reads", "prefetch_reads", "visited", "expanded", "duplicate_skipped")
    return out | {f"{c}_per_query": float(result.get("stats", {}).get(c, 0)) / n for c in counters}
