"""Product quantization: training on a bounded even sample, encoding, and search by table lookups with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vecloom.functions.vectors import pq_offsets, sample_positions, squared_l2
from vecloom.operators import knn
from vecloom.operators.kmeans import DIGITS, matrix, nearest, sums


#: Up to so many rows a rerank depth counts as given.
DEPTH_ROWS = 10_000


@dataclass
class Codebook:
    """Centroids by sub-space, padded to the widest: books[m, c, :width of m]."""

    offsets: list[int]
    books: np.ndarray

    @property
    def dim(self) -> int:
        return self.offsets[-1]

    @property
    def subspaces(self) -> int:
        return len(self.offsets) - 1

    @property
    def centroids(self) -> int:
        return self.books.shape[1]

    def book(self, m: int) -> np.ndarray:
        return self.books[m, :, : self.offsets[m + 1] - self.offsets[m]]

    def frame(self, spark: SparkSession) -> DataFrame:
        """m, c, cv."""
        rows = [(m, c, self.book(m)[c].tolist()) for m in range(self.subspaces) for c in range(self.centroids)]
        return spark.createDataFrame(rows, "m int, c int, cv array<double>")

    def sizes(self, rows: int) -> dict[str, int]:
        """Bytes of the codes and of the codebook as float32 with the full dimension for each centroid."""
        return {"code_bytes": rows * self.subspaces, "codebook_bytes": self.subspaces * self.centroids * self.dim * 4}

    def encode(self, v: np.ndarray) -> np.ndarray:
        return np.stack([nearest(v[:, a:b], self.book(m)) for m, (a, b) in enumerate(zip(self.offsets, self.offsets[1:]))], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        if codes.size and (codes.min() < 0 or codes.max() >= self.centroids or codes.shape[1] != self.subspaces):
            raise ValueError("a code is out of range")
        return np.concatenate([self.book(m)[codes[:, m]] for m in range(self.subspaces)], 1)

    def table(self, q: np.ndarray) -> np.ndarray:
        """Partial squared distances of a query, by sub-space and centroid."""
        return np.stack([((self.book(m) - q[a:b]) ** 2).sum(1) for m, (a, b) in enumerate(zip(self.offsets, self.offsets[1:]))])


def check(dim: int, subspaces: int, centroids: int) -> None:
    if dim < 1 or subspaces < 1:
        raise ValueError("dimension and sub-spaces must be positive")
    if not 2 <= centroids <= 256:
        raise ValueError("centroids must be from 2 to 256")


def initial(base: DataFrame, subspaces: int, centroids: int, train_limit: int = 100_000) -> Codebook:
    """Evenly picked vectors of an even sample. base has ids 0 to N - 1."""
    n = base.count()
    dim = len(base.select("v").head()[0])
    check(dim, subspaces, centroids)
    sample = sample_positions(n, max(centroids, train_limit)) if n else []
    picked = [sample[c * len(sample) // centroids] for c in range(centroids)]
    rows = {r[0]: r[1] for r in base.where(F.col("id").isin(sorted(set(picked)))).select("id", F.col("v").cast("array<double>")).collect()}
    offsets = pq_offsets(dim, subspaces)
    books = np.zeros((len(offsets) - 1, centroids, max(b - a for a, b in zip(offsets, offsets[1:]))))
    for c, i in enumerate(picked):
        for m, (a, b) in enumerate(zip(offsets, offsets[1:])):
            books[m, c, : b - a] = rows[i][a:b]
    return Codebook(offsets, books)


def step(base: DataFrame, book: Codebook, seed: int = 42) -> Codebook:
    """One Lloyd iteration in all sub-spaces; an empty centroid takes a seeded random vector's part."""
    found = sums(base, book.books, book.offsets)
    new = book.books.copy()
    empty = []
    for m in range(book.subspaces):
        width = book.offsets[m + 1] - book.offsets[m]
        for c in range(book.centroids):
            if (m, c) in found:
                n, s = found[m, c]
                new[m, c, :width] = s / n
            else:
                empty.append((m, c))
    if empty:
        drawn = base.orderBy(F.xxhash64(F.lit(seed), "id")).limit(len(empty)).select(F.col("v").cast("array<double>")).collect()
        for (m, c), r in zip(empty, drawn, strict=False):
            a, b = book.offsets[m : m + 2]
            new[m, c, : b - a] = r[0][a:b]
    return Codebook(book.offsets, new)


def fit(base: DataFrame, subspaces: int = 8, centroids: int = 256, train_limit: int = 100_000, iterations: int = 4, seed: int = 42) -> Codebook:
    """Trains on about train_limit rows, drawn by hash where there are more."""
    book = initial(base, subspaces, centroids, train_limit)
    n = base.count()
    train = base if n <= train_limit else base.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)) < train_limit)
    for i in range(iterations):
        book = step(train, book, seed + i)
    return book


def encode(base: DataFrame, book: Codebook) -> DataFrame:
    """id, code."""
    sent = base.sparkSession.sparkContext.broadcast(book)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.encode(matrix(b, 1)).astype(np.int16).tolist(), pa.list_(pa.int16()))], ["id", "code"])

    return base.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(kernel, "id long, code array<smallint>")


def decode(codes: DataFrame, book: Codebook) -> DataFrame:
    """id, v: the centroids' vectors of each code."""
    sent = codes.sparkSession.sparkContext.broadcast(book)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.decode(matrix(b, 1).astype(int)).tolist(), pa.list_(pa.float64()))], ["id", "v"])

    return codes.select(F.col("id").cast("long"), "code").mapInArrow(kernel, "id long, v array<double>")


def adc_table(queries: DataFrame, book: Codebook) -> DataFrame:
    """qid, m, c, d."""
    b = F.broadcast(book.frame(queries.sparkSession))  # 256 x sub-spaces rows at most
    offsets = F.array(*map(F.lit, book.offsets))
    part = F.slice("qv", F.element_at(offsets, F.col("m") + 1) + 1, F.size("cv"))
    return queries.crossJoin(b).select("qid", "m", "c", squared_l2(part, "cv").alias("d"))


def adc_topk(codes: DataFrame, queries: DataFrame, book: Codebook, k: int, block: int | None = None) -> DataFrame:
    """The best k by table lookups for each query, scanning all codes; queries go in blocks whose tables are bounded."""
    spark = codes.sparkSession
    out = None
    slim = queries.select(F.col("qid").cast("long"), F.col("qv").cast("array<double>"))
    for qid, q, _ in knn.query_blocks(slim, 8 * book.subspaces * book.centroids + 64, block):
        # By sub-space: centroids x queries.
        tables = [((q[:, None, a:b] - book.book(m)[None]) ** 2).sum(2).T for m, (a, b) in enumerate(zip(book.offsets, book.offsets[1:]))] if len(qid) else []
        sent = spark.sparkContext.broadcast((qid, tables))

        def kernel(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, tables = sent.value
            best = knn.Best(len(qid), k)
            for batch in batches:
                if not batch.num_rows or not len(qid) or k <= 0:
                    continue
                ids, code = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch, 1).astype(np.int64)
                step = max(1, knn.BLOCK_CELLS // len(qid))
                for a in range(0, len(ids), step):
                    near = tables[0][code[a : a + step, 0]]
                    for m in range(1, len(tables)):
                        near = near + tables[m][code[a : a + step, m]]
                    # Sums of table entries tie often: nine digits make ties equal in whatever order they were summed.
                    near = np.round(near.T, DIGITS)
                    i, j = best.candidates(near)
                    best.offer(i, near[i, j], ids[a + j])
            yield best.batch(qid)

        part = codes.select(F.col("id").cast("long"), "code").mapInArrow(kernel, "qid long, id long, dist double")
        out = part if out is None else out.union(part)
    return knn.rank(out, k)


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact distances of candidates (qid, id): vectors are fetched for these only."""
    joined = candidates.select("qid", "id").join(base.select("id", "v"), "id").join(queries.select("qid", "qv"), "qid")
    return knn.rank(joined.select("qid", "id", squared_l2("v", "qv").alias("dist")), k)


def depth(rerank_topk: int, rows: int) -> int:
    """How many candidates to rerank among so many rows: beyond DEPTH_ROWS more by the root of their number, as more rows have codes as near as those of the true neighbours."""
    return max(rerank_topk, round(rerank_topk * (rows / DEPTH_ROWS) ** 0.5))


def search(base: DataFrame, codes: DataFrame, queries: DataFrame, book: Codebook, k: int, rerank_topk: int = 100) -> DataFrame:
    """rerank_topk: the candidates reranked among DEPTH_ROWS rows; see depth()."""
    return rerank(adc_topk(codes, queries, book, max(k, depth(rerank_topk, base.count()))), base, queries, k)
