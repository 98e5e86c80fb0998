"""A versioned log of vector writes: op_log(seq, node_id, dim, v, nbrs, deleted). Later sequences win; erasing is a row too."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vecloom.operators import knn

FIELDS = ("seq", "node_id", "dim", "v", "nbrs", "deleted")
SCHEMA = "seq long, node_id long, dim int, v array<double>, nbrs array<long>, deleted boolean"


def unique_versions(log: DataFrame) -> DataFrame:
    return log.dropDuplicates(["node_id", "seq"])


def latest(log: DataFrame) -> DataFrame:
    """The newest version of each node, by partial and final aggregation."""
    rest = [c for c in log.columns if c != "node_id"]
    newest = log.groupBy("node_id").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    return newest.select("node_id", *(F.col("r")[c].alias(c) for c in rest)).select(*log.columns)


def latest_at(log: DataFrame, seq: int) -> DataFrame:
    """As of a sequence. The filter reaches the scan."""
    return latest(log.where(F.col("seq") <= seq))


def get(log: DataFrame, node_id: int, seq: int | None = None, include_deleted: bool = False) -> DataFrame:
    """The newest version of a node, or no row."""
    rows = log.where(F.col("node_id") == node_id)
    if seq is not None:
        rows = rows.where(F.col("seq") <= seq)
    newest = rows.orderBy(F.desc("seq")).limit(1)
    return newest if include_deleted else newest.where(~F.col("deleted"))


def latest_for(log: DataFrame, ids: DataFrame, seq: int) -> DataFrame:
    """Newest versions of the listed nodes (column node_id), deleted ones included."""
    return latest_at(log.join(ids.select("node_id").distinct(), "node_id", "left_semi"), seq)


def snapshot(log: DataFrame, seq: int) -> DataFrame:
    """Counts of a snapshot: read_sequence, records, deleted."""
    return latest_at(log, seq).agg(F.lit(seq).cast("long").alias("read_sequence"), F.count(F.lit(1)).alias("records"), F.count_if("deleted").alias("deleted"))


def delta_topk(log: DataFrame, queries: DataFrame, k: int, seq: int, dim: int) -> DataFrame:
    """Top k over live versions of the right dimension."""
    live = latest_at(log, seq).where(~F.col("deleted") & (F.col("dim") == dim))
    return knn.exact(live.select(F.col("node_id").alias("id"), "v"), queries, k, dim)


def merged_topk(base: DataFrame, log: DataFrame, queries: DataFrame, k: int, seq: int, dim: int, base_top: DataFrame | None = None) -> DataFrame:
    """The base's own top k, corrected by the delta: deleting base hits may leave fewer than k rows."""
    base_top = knn.exact(base, queries, k, dim) if base_top is None else base_top
    now = latest_at(log, seq)
    touched = now.where(F.col("deleted") | (F.col("dim") == dim)).select(F.col("node_id").alias("id"))
    return knn.merge_overrides(base_top, touched, delta_topk(log, queries, k, seq, dim), k)


def current(base: DataFrame, log: DataFrame, seq: int, dim: int) -> DataFrame:
    """All live vectors as of a sequence: base rows unless overridden, and new ones."""
    now = latest_at(log, seq).where(F.col("deleted") | (F.col("dim") == dim)).select(F.col("node_id").alias("id"), F.col("v").alias("nv"), "deleted")
    both = base.select("id", F.col("v").cast("array<double>").alias("v")).join(now, "id", "full_outer")
    return both.where(~F.coalesce("deleted", F.lit(False))).select("id", F.coalesce("nv", "v").alias("v"))


def exact_topk(base: DataFrame, log: DataFrame, queries: DataFrame, k: int, seq: int, dim: int) -> DataFrame:
    """Top k over everything that is live, without the merge's loss."""
    return knn.exact(current(base, log, seq, dim), queries, k, dim)


def versions(log: DataFrame, dim: int | None = None) -> DataFrame:
    """Live versions as id, v, since, until: each counts until the next write of its node."""
    w = Window.partitionBy("node_id").orderBy("seq")
    each = log.select("node_id", "seq", "v", "dim", "deleted", F.lead("seq").over(w).alias("next"))
    live = each.where(~F.col("deleted") & (F.lit(True) if dim is None else F.col("dim") == dim))
    return live.select(F.col("node_id").alias("id"), "v", F.col("seq").alias("since"), F.coalesce("next", F.lit((1 << 63) - 1)).alias("until"))


def topk_as_of(log: DataFrame, reads: DataFrame, k: int, dim: int) -> DataFrame:
    """reads: qid, qv, at. Of the log's versions, the k nearest that each read sees, all reads in one pass."""
    return knn.exact_as_of(versions(log, dim), reads, k, dim)


def merged_as_of(base: DataFrame, log: DataFrame, reads: DataFrame, k: int, dim: int, base_top: DataFrame | None = None) -> DataFrame:
    """reads: qid, qv, at. merged_topk for reads that are each as of their own sequence."""
    top = knn.for_each(reads, lambda q: knn.exact(base, q, k, dim), dim) if base_top is None else base_top
    first = log.where(F.col("deleted") | (F.col("dim") == dim)).groupBy("node_id").agg(F.min("seq").alias("touched"))
    seen = top.join(reads.select("qid", "at"), "qid").join(first, top["id"] == first["node_id"], "left")
    left = seen.where(F.col("touched").isNull() | (F.col("touched") > F.col("at"))).select("qid", "id", "dist")
    return knn.rank(left.unionByName(topk_as_of(log, reads, k, dim).select("qid", "id", "dist")), k)


def exact_as_of(base: DataFrame, log: DataFrame, reads: DataFrame, k: int, dim: int) -> DataFrame:
    """reads: qid, qv, at. The k nearest of all that is live for each read: base rows count until their node is first written."""
    first = log.where(F.col("deleted") | (F.col("dim") == dim)).groupBy("node_id").agg(F.min("seq").alias("touched"))
    old = base.join(first, base["id"] == first["node_id"], "left").select("id", F.col("v").cast("array<double>").alias("v"), F.lit(0).cast("long").alias("since"), F.coalesce("touched", F.lit((1 << 63) - 1)).alias("until"))
    return knn.exact_as_of(old.unionByName(versions(log, dim)), reads, k, dim)


def incremental_neighbors(log: DataFrame, targets: DataFrame, degree: int = 16) -> DataFrame:
    """For each written version in targets (seq, node_id, v): the nearest live versions of other nodes at that time."""
    dims = [r[0] for r in targets.select(F.size("v").alias("dim")).distinct().collect()]
    out = None
    for dim in dims or [1]:
        t = targets.where(F.size("v") == dim).select(F.col("seq").alias("qid"), F.col("node_id").alias("skip"), F.col("v").alias("qv"), (F.col("seq") - 1).alias("at"))
        one = knn.exact_blocks(versions(log, dim), t, degree, dim)
        out = one if out is None else out.unionByName(one)
    return out


def memtable(log: DataFrame, flushed: int = 0) -> DataFrame:
    """What is in memory after the writes beyond a flushed sequence, and its bytes: 48 for a record, 4 for each float, 8 for each neighbour."""
    held = latest(log.where(F.col("seq") > flushed))
    size = F.lit(48) + 4 * F.coalesce(F.size("v"), F.lit(0)) * F.when(F.col("v").isNull(), 0).otherwise(1) + 8 * F.when(F.col("nbrs").isNull(), 0).otherwise(F.size("nbrs"))
    return held.withColumn("bytes", size.cast("long"))


def tables(log: DataFrame, rows_per_table: int) -> DataFrame:
    """The log cut into flushes of so many writes: table_id, and the newest version of each node in it."""
    cut = log.withColumn("table_id", F.expr(f"(seq - 1) div {rows_per_table}"))
    rest = [c for c in log.columns if c != "node_id"]
    newest = cut.groupBy("table_id", "node_id").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    return newest.select("table_id", "node_id", *(F.col("r")[c].alias(c) for c in rest))


def compact(parts: DataFrame) -> DataFrame:
    """One version of each node over all tables, the newest; erased nodes stay as such."""
    return latest(parts.drop("table_id"))


def compaction_counts(parts: DataFrame) -> DataFrame:
    return parts.agg(F.count_distinct("table_id").alias("tables_in"), F.count(F.lit(1)).alias("records_in"), F.count_distinct("node_id").alias("records_out"))


def point_in_time(reads: DataFrame, log: DataFrame) -> DataFrame:
    """For each read (seq as read_seq, node_id) the version it sees: an as-of join by window over both."""
    both = log.select("node_id", "seq", F.lit(None).cast("long").alias("read_seq"), F.col("seq").alias("version")).unionByName(reads.select("node_id", F.col("read_seq").alias("seq"), "read_seq", F.lit(None).cast("long").alias("version")))
    w = Window.partitionBy("node_id").orderBy("seq", F.col("read_seq").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("version", F.last("version", ignorenulls=True).over(w)).where("read_seq is not null").select("node_id", "read_seq", "version")


def _sum(log: DataFrame):
    return F.xxhash64(*(F.col(c) for c in ("seq", "node_id", "dim", "v", "nbrs", "deleted")))


def record_bytes(v: list | None, nbrs: list | None) -> int:
    """What a record takes in memory: 48 bytes, 4 for each float, 8 for each neighbour."""
    return 48 + 4 * len(v or ()) + 8 * len(nbrs or ())


def with_checksum(log: DataFrame) -> DataFrame:
    return log.withColumn("checksum", _sum(log))


def intact(log: DataFrame) -> DataFrame:
    """Without the rows whose checksum doesn't hold; rows that never had one stay."""
    return log.where(F.col("checksum").isNull() | (F.col("checksum") == _sum(log))).drop("checksum")


def valid_prefix(log: DataFrame) -> DataFrame:
    """Replays a log up to its first damaged record: rows before the least sequence whose checksum doesn't hold."""
    broken = log.where(~F.col("checksum").eqNullSafe(_sum(log))).agg(F.min("seq").alias("broken"))
    return log.crossJoin(F.broadcast(broken)).where(F.col("broken").isNull() | (F.col("seq") < F.col("broken"))).drop("checksum", "broken")


def replay_stats(log: DataFrame) -> DataFrame:
    """What a replay would see: inserts, deletes, the highest node and the next sequence."""
    return log.agg(F.count_if(~F.col("deleted")).alias("inserts"), F.count_if("deleted").alias("deletes"), F.max("node_id").alias("max_node"), (F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_sequence"))
