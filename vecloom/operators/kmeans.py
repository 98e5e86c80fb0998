"""Lloyd iterations over a distributed table, with the centroids on the driver (they are few by definition)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Distances are rounded before they are compared, so that engines which sum in other orders agree on ties.
DIGITS = 9


def matrix(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """An array column as a matrix."""
    n = batch.num_rows
    return np.asarray(batch.column(i).flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) if n else np.zeros((0, 0))


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of v from all rows of c, without cancellation."""
    out = np.empty((len(v), len(c)))
    for j in range(len(c)):
        out[:, j] = ((v - c[j]) ** 2).sum(1)
    return out


def nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The lowest index among the nearest centroids."""
    return np.round(distances(v, c), DIGITS).argmin(1)


def assign(base: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, v, c (nearest centroid), dist."""
    sent = base.sparkSession.sparkContext.broadcast(centroids)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = distances(matrix(b, 1), sent.value)
                c = np.round(d, DIGITS).argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c.astype(np.int32)), pa.array(d[np.arange(len(c)), c])], ["id", "v", "c", "dist"])

    return base.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(kernel, "id long, v array<double>, c int, dist double")


def sums(base: DataFrame, centroids: np.ndarray, offsets: list[int] | None = None) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """(sub-space, centroid) -> number and sum of its vectors. Tasks add up their own rows; few rows are collected."""
    spark = base.sparkSession
    offsets = offsets or [0, centroids.shape[1]]
    sent = spark.sparkContext.broadcast((centroids, offsets))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        c, at = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b, 0)
            for m in range(len(at) - 1):
                part = v[:, at[m] : at[m + 1]]
                book = c[m] if c.ndim == 3 else c
                book = book[:, : part.shape[1]]
                near = nearest(part, book)
                for j in np.unique(near):
                    held = total.setdefault((m, int(j)), [0, np.zeros(part.shape[1])])
                    held[0] += int((near == j).sum())
                    held[1] += part[near == j].sum(0)
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m for m, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()), pa.array([total[k][1].tolist() for k in keys], pa.list_(pa.float64()))],
            ["m", "c", "n", "s"],
        )

    parts = base.select(F.col("v").cast("array<double>")).mapInArrow(kernel, "m int, c int, n long, s array<double>")
    each = parts.select("m", "c", "n", F.posexplode("s").alias("d", "x")).groupBy("m", "c", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    for m, c, d, n, x in each.orderBy("m", "c", "d").collect():
        out.setdefault((m, c), (n, np.zeros(offsets[m + 1] - offsets[m])))[1][d] = x
    return out


def lloyd(base: DataFrame, centroids: np.ndarray, iterations: int, reseed: bool = False) -> np.ndarray:
    """Moves centroids to the means of their vectors. An empty one stays, or with `reseed` takes the vector farthest from its centroid."""
    c = np.array(centroids, float)
    for _ in range(iterations):
        found = sums(base, c)
        new = c.copy()
        for (_, j), (n, s) in found.items():
            new[j] = s / n
        empty = [j for j in range(len(c)) if (0, j) not in found]
        if empty and reseed:
            far = assign(base, c).orderBy(F.desc("dist"), "id").limit(len(empty)).collect()
            for j, r in zip(empty, far, strict=False):
                new[j] = r["v"]
        c = new
    return c


def farthest_first(base: DataFrame, count: int, first: int = 0, ahead: int = 256) -> list[tuple[int, list[float]]]:
    """Centroids by farthest-first traversal from vector `first`: each next one is farthest from all before (smallest id on a tie).

    A pass over the table gives the `ahead` farthest vectors. Distances only fall as centroids come, so as long as one of these
    is still farther than the last of them was, it is the next, and no other pass is needed.
    """
    start = base.where(F.col("id") == first).select("id", F.col("v").cast("array<double>")).head()
    if start is None:
        raise ValueError(f"no vector {first}")
    chosen = [(start[0], list(start[1]))]
    while len(chosen) < count:
        rows = _least(base, np.array([v for _, v in chosen])).orderBy(F.desc("least"), "id").limit(ahead).collect()
        ids, v, least = [r["id"] for r in rows], np.array([r["v"] for r in rows]), np.array([r["least"] for r in rows])
        bound = least[-1] if len(rows) == ahead else -1.0
        taken = False
        while len(chosen) < count:
            i = min(range(len(rows)), key=lambda i: (-least[i], ids[i]))
            if taken and least[i] <= bound:
                break
            taken = True
            chosen.append((ids[i], v[i].tolist()))
            least = np.minimum(least, np.round(((v - v[i]) ** 2).sum(1), DIGITS))
    return chosen


def _least(base: DataFrame, c: np.ndarray) -> DataFrame:
    return assign(base, c).select("id", "v", F.round("dist", DIGITS).alias("least"))
