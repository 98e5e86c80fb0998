"""Inverted-file search: vectors in the bucket of their nearest centroid, queries scan their nprobe nearest buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vecloom.functions.vectors import squared_l2
from vecloom.operators import kmeans, knn


#: Vectors inserted before buckets are trained anew.
REBUILD = 100_000


class IvfFlat:
    def __init__(self, centroids: np.ndarray, rows: DataFrame, dirty: int = 0, interval: int = REBUILD):
        """rows: id, v, c. dirty: how many were inserted since the centroids were trained."""
        if interval < 1:
            raise ValueError("the interval of rebuilding must be positive")
        self.centroids, self.rows, self.dirty, self.interval = centroids, rows, dirty, interval

    @classmethod
    def build(cls, base: DataFrame, centroids: int, iterations: int = 4) -> IvfFlat:
        start = np.array([v for _, v in kmeans.farthest_first(base, centroids, base.agg(F.min("id")).head()[0])])
        c = kmeans.lloyd(base, start, iterations, reseed=True)
        return cls(c, kmeans.assign(base, c).drop("dist"))

    def insert(self, more: DataFrame, rebuild: bool | None = None, iterations: int = 4) -> IvfFlat:
        """Appends vectors to their nearest buckets. Buckets are trained anew over all while there are no more vectors than centroids, and when `interval` have come since the last time, or as `rebuild` says. Repeated ids stay."""
        dirty = self.dirty + more.count()
        if rebuild is None:
            rebuild = dirty >= self.interval or self.rows.count() + dirty - self.dirty <= len(self.centroids)
        if not rebuild:
            return IvfFlat(self.centroids, self.rows.unionByName(kmeans.assign(more, self.centroids).drop("dist")), dirty, self.interval)
        every = self.rows.select("id", "v").unionByName(more.select("id", F.col("v").cast("array<double>")))
        found = IvfFlat.build(every, min(len(self.centroids), self.rows.count() + more.count()), iterations)
        return IvfFlat(found.centroids, found.rows, 0, self.interval)

    def save(self, path: str) -> None:
        """Buckets become partitions, so that a search reads only those that are probed."""
        self.rows.write.partitionBy("c").parquet(f"{path}/buckets")
        spark = self.rows.sparkSession
        spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(self.centroids)], "c int, cv array<double>").coalesce(1).write.parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfFlat:
        c = spark.read.parquet(f"{path}/centroids").orderBy("c").collect()
        return cls(np.array([r["cv"] for r in c]), spark.read.parquet(f"{path}/buckets"))

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """qid, qv, c."""
        c = queries.sparkSession.createDataFrame([(j, v.tolist()) for j, v in enumerate(self.centroids)], "c int, cv array<double>")
        near = queries.crossJoin(F.broadcast(c)).select("qid", "qv", "c", F.round(squared_l2("qv", "cv"), kmeans.DIGITS).alias("d"))
        w = Window.partitionBy("qid").orderBy("d", "c")
        return near.withColumn("i", F.row_number().over(w)).where(F.col("i") <= nprobe).select("qid", "qv", "c")

    def search(self, queries: DataFrame, k: int, nprobe: int = 8) -> DataFrame:
        """The k nearest in the probed buckets. Queries are sent in bounded blocks and each task compares its rows with the queries that probe their bucket, so no bucket, however full, meets in one task; of saved buckets only probed ones are read."""
        spark = self.rows.sparkSession
        c, out = self.centroids, None
        slim = queries.select(F.col("qid").cast("long"), F.col("qv").cast("array<double>"))
        for qid, q, _ in knn.query_blocks(slim, 8 * c.shape[1] + 64):
            near = np.round(kmeans.distances(q, c), kmeans.DIGITS) if len(qid) else np.zeros((0, len(c)))
            order = np.argsort(near, axis=1, kind="stable")[:, :nprobe]
            asked = {j: np.nonzero((order == j).any(1))[0] for j in range(len(c))}
            sent = spark.sparkContext.broadcast((qid, q, {j: x for j, x in asked.items() if len(x)}))

            def kernel(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                qid, q, asked = sent.value
                best, norms = knn.Best(len(qid), k), (q * q).sum(1)
                for b in batches:
                    ids, all_, own = b.column(0).to_numpy(zero_copy_only=False), kmeans.matrix(b, 1), b.column(2).to_numpy(zero_copy_only=False)
                    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                    for j in np.unique(own).tolist() if k > 0 else []:
                        mine, at = np.nonzero(own == j)[0], asked.get(j, np.empty(0, np.int64))
                        step = max(1, knn.BLOCK_CELLS // max(1, len(at)))
                        for a in range(0, len(mine) if len(at) else 0, step):
                            rows = mine[a : a + step]
                            v = all_[rows]
                            # Matrix products tell what may rank; that is taken exactly.
                            near = norms[at][:, None] + (v * v).sum(1) - 2 * q[at] @ v.T
                            n = min(k, len(rows))
                            cut = np.minimum(np.partition(near, n - 1, axis=1)[:, n - 1], best.limit[at]) + 1e-9 * (1 + norms[at])
                            x, y = np.nonzero(near <= cut[:, None])
                            found.append((at[x], ((v[y] - q[at[x]]) ** 2).sum(1), ids[rows[y]]))
                    if found:
                        best.offer(*(np.concatenate(c) for c in zip(*found)))
                yield best.batch(qid)

            probed = sorted(j for j, x in asked.items() if len(x))
            part = self.rows.where(F.col("c").isin(probed)).select(F.col("id").cast("long"), F.col("v").cast("array<double>"), F.col("c").cast("int")).mapInArrow(kernel, "qid long, id long, dist double")
            out = part if out is None else out.union(part)
        return knn.rank(out, k)
