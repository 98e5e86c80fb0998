"""Exact nearest neighbours and merging of ranked lists. Everything ranks by (dist, id)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vecloom.functions.vectors import squared_l2

#: A side is broadcast up to this size only.
BROADCAST_BYTES = 32 << 20
#: Queries that are searched in one pass, and distances that a task holds at a time.
BLOCK_QUERIES, BLOCK_CELLS = 1 << 14, 1 << 22
#: Of reads as of a time: parts of time whose limits are looked up at once, and cells gathered before they are ranked. They decide nothing.
TIME_PARTS, PENDING = 64, 1 << 18


def rank(df: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The best k rows of each query with their rank rk. Catalyst keeps k rows a task before the shuffle."""
    w = Window.partitionBy(*by).orderBy("dist", "id")
    return df.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def one(base: DataFrame, query: list[float], k: int) -> DataFrame:
    """Top k for one query vector; a bounded heap in each task."""
    dist = squared_l2("v", F.array(*(F.lit(float(x)) for x in query)))
    return base.select("id", dist.alias("dist")).orderBy("dist", "id").limit(max(k, 0))


def bounded(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df is small enough to broadcast: by the optimizer's upper estimate if that leaves room for decoding, else by counting no further than the limit."""
    if 8 * int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit:
        return True
    most = max(1, limit // row_bytes)
    return df.limit(most + 1).count() <= most


def exact(base: DataFrame, queries: DataFrame, k: int, dim: int = 64, method: str = "blocks") -> DataFrame:
    """Top k of base (id, v) for each query (qid, qv): by matrix products (blocks), or as a broadcast theta join without Python (join) while the queries fit the broadcast bound."""
    if method not in ("blocks", "join"):
        raise ValueError(f"unknown method: {method}")
    if method == "blocks" or not bounded(queries, 8 * dim + 64):
        return exact_blocks(base, queries, k, dim)
    pairs = base.crossJoin(F.broadcast(queries)) if k else base.crossJoin(queries.limit(0))
    return rank(pairs.select("qid", "id", squared_l2("v", "qv").alias("dist")), k)


class Best:
    """The best k rows of each of n queries so far, as flat columns: position of the query, distance, id. Ids stay integers."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.at, self.dist, self.ids = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.limit = np.full(n, np.inf)  # the k-th distance

    def offer(self, at: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        at, dist, ids = np.concatenate([self.at, at]), np.concatenate([self.dist, dist]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, dist, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep, last = rank < self.k, rank == self.k - 1
        self.limit[at[last]] = dist[order[last]]
        self.at, self.dist, self.ids = at[keep], dist[order[keep]], ids[order[keep]]

    def candidates(self, near: np.ndarray, slack: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """near: queries x rows. The cells that may rank, if distances are right up to the slack."""
        k = min(self.k, near.shape[1])
        cut = np.minimum(np.partition(near, k - 1, axis=1)[:, k - 1], self.limit)
        return np.nonzero((near <= (cut + slack)[:, None]) & (near < np.inf))

    def batch(self, qid: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(qid[self.at], pa.int64()), pa.array(self.ids, pa.int64()), pa.array(self.dist)], ["qid", "id", "dist"])


def query_blocks(queries: DataFrame, row_bytes: int, block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """queries: qid, qv, and more. Blocks of bounded size: qid, a matrix, and all columns."""
    block = block or max(1, min(BLOCK_QUERIES, BROADCAST_BYTES // row_bytes))
    n = max(1, ceil(queries.count() / block))
    for b in range(n):
        rows = (queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == b) if n > 1 else queries).toArrow()
        qid = rows.column("qid").to_numpy().astype(np.int64)
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column("qv").chunks] or [np.empty(0)])
        yield qid, flat.astype(float).reshape(len(qid), -1) if len(qid) else np.zeros((0, 0)), rows


def exact_blocks(base: DataFrame, queries: DataFrame, k: int, dim: int = 64, block: int | None = None) -> DataFrame:
    """The same by matrix products: queries in blocks of bounded size are sent to all tasks, each gives its own best k. A task holds BLOCK_CELLS distances at a time.

    base may have `since` and `until`, and queries `at` and `skip`: then a row counts for queries with since <= at < until and another id than skip.
    """
    spark = base.sparkSession
    timed = "since" in base.columns
    out = None
    slim = queries.select(F.col("qid").cast("long"), F.col("qv").cast("array<double>"), *((F.col("at").cast("long"), F.coalesce(F.col("skip").cast("long"), F.lit(-1).cast("long")).alias("skip")) if timed else ()))
    for qid, q, rows in query_blocks(slim, 8 * dim + 64, block):
        when = np.stack([rows.column(c).to_numpy() for c in ("at", "skip")]) if timed else None
        sent = spark.sparkContext.broadcast((qid, q, when))

        def kernel(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, q, when = sent.value
            best, norms = Best(len(qid), k), (q * q).sum(1)
            for batch in batches:
                if not batch.num_rows or not len(qid) or k <= 0:
                    continue
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                all_ = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(len(ids), -1)
                if all_.shape[1] != q.shape[1]:
                    raise ValueError("dimensions differ")
                step = max(1, BLOCK_CELLS // len(qid))
                for a in range(0, len(ids), step):
                    v = all_[a : a + step]
                    # Matrix products tell what may rank; that is taken exactly.
                    near = norms[:, None] + (v * v).sum(1) - 2 * q @ v.T
                    if when is not None:
                        since, until = (batch.column(c).to_numpy(zero_copy_only=False)[a : a + step] for c in (2, 3))
                        near[(since[None] > when[0][:, None]) | (until[None] <= when[0][:, None]) | (ids[None, a : a + step] == when[1][:, None])] = np.inf
                    i, j = best.candidates(near, 1e-9 * (1 + norms))
                    dist = np.empty(len(i))
                    for b in range(0, len(i), 1 << 14):
                        dist[b : b + (1 << 14)] = ((v[j[b : b + (1 << 14)]] - q[i[b : b + (1 << 14)]]) ** 2).sum(1)
                    best.offer(i, dist, ids[a + j])
            yield best.batch(qid)

        columns = [F.col("id").cast("long"), F.col("v").cast("array<double>"), *((F.col("since").cast("long"), F.col("until").cast("long")) if timed else ())]
        part = base.select(*columns).mapInArrow(kernel, "qid long, id long, dist double")
        out = part if out is None else out.union(part)
    return rank(out, k)


def shared(reads: DataFrame, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """reads: qid (distinct), qv, at. The distinct vectors (asked, qv, and their sorted distinct times ats), and each read with its own (qid, asked, at); asked is the vector's smallest qid."""
    slim = reads.select(F.col("qid").cast("long"), F.col("qv").cast("array<double>"), F.col("at").cast("long"))
    groups = slim.groupBy("qv").agg(F.min("qid").alias("asked"), F.sort_array(F.collect_set("at")).alias("ats"))
    names = groups.select("qv", "asked")
    return groups, slim.join(F.broadcast(names) if bounded(names, 8 * dim + 64) else names, "qv").select("qid", "asked", "at")


def for_each(reads: DataFrame, search: Callable[[DataFrame], DataFrame], dim: int = 64) -> DataFrame:
    """What search finds for each read (qid, qv, at), by one search for each distinct vector."""
    groups, members = shared(reads, dim)
    found = search(groups.select(F.col("asked").alias("qid"), "qv")).withColumnRenamed("qid", "asked")
    return found.join(members.select("qid", "asked"), "asked").drop("asked")


def sweep(dist: list[float], lo: np.ndarray, hi: np.ndarray, reads: int, k: int) -> tuple[list[int], np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Rows of one query, the nearest first, each seen by its reads lo to hi - 1. Which rank among the first k of some read, each read's k-th distance, and by such row the reads and its ranks there."""
    count, limit = np.zeros(reads, np.int64), np.full(reads, np.inf)
    kept, places, left = [], [], np.arange(len(lo))
    while len(left):
        now, left = left[:64], left[64:]
        for i, a, z in zip(now.tolist(), lo[now].tolist(), hi[now].tolist()):
            c = count[a:z]
            at = np.nonzero(c < k)[0]
            if len(at):
                c[at] += 1
                limit[a:z][at[c[at] == k]] = dist[i]
                kept.append(i)
                places.append((i, at + a, c[at]))
        if len(left):  # only rows that some read with room sees
            room = np.concatenate([[0], np.cumsum(count < k)])
            left = left[room[hi[left]] > room[lo[left]]]
    return kept, limit, places


class Reads:
    """Reads of few vectors at many times: for a row, the reads of each vector that see it are a range. Holds the rows that rank among the first k of some read so far, as flat columns: vector, distance, id, first read, read behind the last, since, until."""

    def __init__(self, ends: np.ndarray, ats: np.ndarray, k: int):
        """ends: where each vector's times begin in ats, and the end."""
        self.k, self.ends, self.times = k, ends, np.unique(ats)
        self.at = np.searchsorted(self.times, ats)
        self.of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        self.key = self.of * (len(self.times) + 1) + self.at
        self.limit = np.full(len(ats), np.inf)
        self.held = [np.empty(0, np.int64), np.empty(0), *(np.empty(0, np.int64) for _ in range(5))]
        self.pending: list[list[np.ndarray]] = []
        self._table()

    def _part(self, rank: np.ndarray) -> np.ndarray:
        return rank * TIME_PARTS // max(1, len(self.times))

    def _table(self) -> None:
        """The greatest limit of each vector's reads in 2**j parts of time from each on: rows j * TIME_PARTS + part, columns vectors."""
        n = len(self.ends) - 1
        one = np.full((TIME_PARTS, n), -np.inf)
        np.maximum.at(one, (self._part(self.at), self.of), self.limit)
        levels = [one]
        while (1 << len(levels)) <= TIME_PARTS:
            last, step = levels[-1], 1 << (len(levels) - 1)
            levels.append(np.maximum(last, np.concatenate([last[step:], np.full((step, n), -np.inf)])))
        self.table = np.concatenate(levels)

    def seen(self, since: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of the times that see a row, from the first to behind the last."""
        return np.searchsorted(self.times, since), np.searchsorted(self.times, until)

    def limits(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """rows x vectors: no row beyond this can rank. a < z."""
        first, last = self._part(a), self._part(z - 1)
        j = np.frexp((last - first + 1).astype(float))[1] - 1
        return np.maximum(self.table[j * TIME_PARTS + first], self.table[j * TIME_PARTS + last + 1 - (1 << j)])

    def ranges(self, of: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = of * (len(self.times) + 1)
        return np.searchsorted(self.key, first + a), np.searchsorted(self.key, first + z)

    def offer(self, *columns: np.ndarray) -> None:
        self.pending.append(list(columns))
        if sum(len(c[0]) for c in self.pending) >= max(PENDING, len(self.held[0])):
            self.settle()

    def settle(self) -> None:
        if not self.pending:
            return
        changed = np.unique(np.concatenate([c[0] for c in self.pending]))
        columns = [np.concatenate(x) for x in zip(self.held, *self.pending)]
        self.pending = []
        order = np.lexsort((columns[2], columns[1], columns[0]))
        columns = [c[order] for c in columns]
        keep = np.ones(len(order), bool)
        begins, stops = np.searchsorted(columns[0], changed), np.searchsorted(columns[0], changed, "right")
        for q, s, e in zip(changed.tolist(), begins.tolist(), stops.tolist()):
            f, g = int(self.ends[q]), int(self.ends[q + 1])
            kept, self.limit[f:g], _ = sweep(columns[1][s:e].tolist(), columns[3][s:e] - f, columns[4][s:e] - f, g - f, self.k)
            keep[s:e] = False
            keep[s + np.array(kept, np.int64)] = True
        self.held = [c[keep] for c in columns]
        self._table()


def exact_as_of(base: DataFrame, reads: DataFrame, k: int, dim: int = 64, block: int | None = None) -> DataFrame:
    """base: id, v, since, until. reads: qid (distinct), qv, at. Top k of the rows with since <= at < until for each read.

    Distances are taken once for each distinct vector, however many reads ask for it. A task gives, of its rows, those which rank
    for some read; those of one vector then meet, and its reads are told from them in one sweep by distance.
    """
    spark = base.sparkSession
    groups, members = shared(reads, dim)
    names, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ats")), F.lit(0))).head()
    row_bytes = 8 * dim + 64 + 8 * (total // max(1, names))
    out = None
    for asked, q, held in query_blocks(groups.select(F.col("asked").alias("qid"), "qv", "ats"), row_bytes, block):
        ats = held.column("ats").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(ats.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64) if len(asked) else np.zeros(1, np.int64)
        sent = spark.sparkContext.broadcast((asked, q, ends, ats.flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(asked) else np.empty(0, np.int64)))

        def ranking(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, q, ends, ats = sent.value
            best, norms = Reads(ends, ats, k), (q * q).sum(1)
            most = max(1, BLOCK_CELLS // max(1, len(asked)))
            step = min(256, most)  # few rows first, as they give the limits for the others
            for batch in batches:
                if not batch.num_rows or not len(asked) or k <= 0:
                    continue
                ids, since, until = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3))
                every = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(len(ids), -1)
                if every.shape[1] != q.shape[1]:
                    raise ValueError("dimensions differ")
                first, last = best.seen(since, until)
                rows = np.nonzero(first < last)[0]
                start = 0
                while start < len(rows):
                    some, start, step = rows[start : start + step], start + step, min(4 * step, most)
                    v, a, z = every[some], first[some], last[some]
                    # Matrix products tell what may rank; that is taken exactly.
                    near = v @ (-2 * q.T)
                    near += (v * v).sum(1)[:, None]
                    near += norms * (1 - 1e-9) - 1e-9
                    i, j = np.nonzero(near <= best.limits(a, z))
                    lo, hi = best.ranges(j, a[i], z[i])
                    left = lo < hi
                    i, j, lo, hi = i[left], j[left], lo[left], hi[left]
                    dist = np.empty(len(i))
                    for b in range(0, len(i), 1 << 14):
                        dist[b : b + (1 << 14)] = ((v[i[b : b + (1 << 14)]] - q[j[b : b + (1 << 14)]]) ** 2).sum(1)
                    best.offer(j, dist, ids[some[i]], lo, hi, since[some[i]], until[some[i]])
            best.settle()
            of, dist, ids, _, _, since, until = best.held
            yield pa.RecordBatch.from_arrays([pa.array(asked[of]), pa.array(dist), *(pa.array(c.astype(np.int64)) for c in (ids, since, until))], ["asked", "dist", "id", "since", "until"])

        def telling(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, _, ends, ats = sent.value
            place = {x: i for i, x in enumerate(asked.tolist())}

            def told(rows: pa.Table) -> pa.RecordBatch:
                dist, ids, since, until = (rows.column(c).to_numpy() for c in ("dist", "id", "since", "until"))
                x = rows.column("asked")[0].as_py()
                own = ats[ends[place[x]] : ends[place[x] + 1]]
                _, _, got = sweep(dist.tolist(), np.searchsorted(own, since), np.searchsorted(own, until), len(own), k)
                i = np.repeat(np.array([r for r, _, _ in got], np.int64), [len(at) for _, at, _ in got])
                at, rk = (np.concatenate([np.empty(0, np.int64), *(g[c] for g in got)]) for c in (1, 2))
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), x)), pa.array(own[at]), pa.array(ids[i]), pa.array(dist[i]), pa.array(rk.astype(np.int32))], ["asked", "at", "id", "dist", "rk"])

            kept: list[pa.RecordBatch] = []
            for batch in batches:  # a vector's rows come together
                names = batch.column(0).to_numpy()
                cuts = [0, *(np.nonzero(np.diff(names))[0] + 1).tolist(), len(names)]
                for s, e in zip(cuts, cuts[1:]):
                    part = batch.slice(s, e - s)
                    if kept and e > s and kept[0].column(0)[0].as_py() != names[s]:
                        yield told(pa.Table.from_batches(kept))
                        kept = []
                    if e > s:
                        kept.append(part)
            if kept:
                yield told(pa.Table.from_batches(kept))

        slim = base.select(F.col("id").cast("long"), F.col("v").cast("array<double>"), F.col("since").cast("long"), F.col("until").cast("long"))
        ranked = slim.mapInArrow(ranking, "asked long, dist double, id long, since long, until long")
        part = ranked.repartition("asked").sortWithinPartitions("asked", "dist", "id").mapInArrow(telling, "asked long, at long, id long, dist double, rk int")
        out = part if out is None else out.union(part)
    return out.join(members, ["asked", "at"]).select("qid", "id", "dist", "rk")


def merge_min(lists: list[DataFrame], k: int) -> DataFrame:
    """Merges ranked lists; an id counts with its least distance."""
    every = lists[0].select("qid", "id", "dist")
    for x in lists[1:]:
        every = every.unionByName(x.select("qid", "id", "dist"))
    return rank(every.groupBy("qid", "id").agg(F.min("dist").alias("dist")), k)


def merge_overrides(base_top: DataFrame, touched: DataFrame, delta: DataFrame, k: int) -> DataFrame:
    """Base hits whose id was touched (updated or deleted) go; live delta hits come; ranked anew. May give fewer than k."""
    left = base_top.join(touched.select("id"), "id", "left_anti").select("qid", "id", "dist")
    return rank(left.unionByName(delta.select("qid", "id", "dist")), k)


def self_graph(base: DataFrame, k: int, dim: int = 64) -> DataFrame:
    """Exact neighbours of every vector but itself: src, pos, dst, dist."""
    queries = base.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    found = exact(base, queries, k + 1, dim).where("id <> qid")
    w = Window.partitionBy("qid").orderBy("dist", "id")
    return found.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < k).select(F.col("qid").alias("src"), "pos", F.col("id").alias("dst"), "dist")


class FlatDelta:
    """A delta of two blocks, active and sealed, searched separately and merged."""

    def __init__(self, rows: DataFrame):
        """rows: id, v, arrival (order of insertion)."""
        self.rows = rows.withColumn("sealed", F.lit(False)) if "sealed" not in rows.columns else rows

    def compact(self, n: int) -> FlatDelta:
        """The n oldest active vectors become sealed."""
        oldest = self.rows.where(~F.col("sealed")).orderBy("arrival").limit(n).select("arrival", F.lit(True).alias("moves"))
        moved = self.rows.join(oldest, "arrival", "left")
        return FlatDelta(moved.withColumn("sealed", F.col("sealed") | F.coalesce("moves", F.lit(False))).drop("moves"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return merge_min([exact(self.rows.where(c).select("id", "v"), queries, k) for c in ("sealed", "not sealed")], k)
