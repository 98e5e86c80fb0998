"""Sharded proximity graphs: building, searching, node order and pages, saving and loading.

Sequential algorithms run inside a shard (one task, at most SHARD_ROWS nodes); shards are bounded hash parts of k-means
cells. A search runs in every shard and the ranked lists are merged. Index rows: shard, id, v, nbrs, entry.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vecloom.functions.vectors import nodes_per_page, squared_l2
from vecloom.operators import kmeans, knn
from vecloom.operators.graph import candidates as cand, kernels
from vecloom.operators.pq import Codebook

SHARD_ROWS = 50_000
POLICIES = ("exact", "approx-rp", "lsh-rp", "lsh-vamana", "vamana")
PACKINGS = ("random", "bfs", "coaccess", "hotpath")
INDEX = "shard int, id long, v array<double>, nbrs array<long>, entry long"


@dataclass
class BuildConfig:
    degree: int = 32
    candidate_limit: int = 256
    alpha: float = 1.2
    seed: int = 42
    policy: str = "vamana"
    projections: int = 8
    window: int = 24
    random_samples: int = 32
    reverse_patch: bool = True
    lsh_tables: int = 8
    lsh_bits: int = 14
    lsh_radius: int = 0
    bucket_limit: int = 64
    page_size: int = 4096

    def __post_init__(self):
        if self.policy not in POLICIES:
            raise ValueError(f"unknown build policy: {self.policy}")
        if self.degree < 1 or self.alpha < 1 or self.candidate_limit < 1:
            raise ValueError("degree and candidate limit must be positive, alpha 1 or more")


def shards(base: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """base with a column shard: k-means cells, split by hash where they hold more than `rows`."""
    n = base.count()
    count = max(1, -(-n // rows))
    plain = base.select("id", F.col("v").cast("array<double>").alias("v"))
    if count == 1:
        return plain.withColumn("shard", F.lit(0))
    start = plain.orderBy(F.xxhash64("id")).limit(count).collect()
    placed = kmeans.assign(plain, kmeans.lloyd(plain, np.array([r["v"] for r in start]), 2))
    sizes = {r[0]: r[1] for r in placed.groupBy("c").count().collect()}
    first, parts = 0, []
    for c, size in sorted(sizes.items()):
        split = -(-size // rows)
        parts.append((c, first, split))
        first += split
    table = base.sparkSession.createDataFrame(parts, "c int, first int, split int")
    return placed.join(F.broadcast(table), "c").select("id", "v", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("split"))).cast("int").alias("shard"))


def vamana(base: DataFrame, config: BuildConfig | None = None, deleted: DataFrame | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Builds a graph in each shard. Deleted nodes take no part."""
    c = config or BuildConfig()
    live = base if deleted is None else base.join(deleted.select("id"), "id", "left_anti")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, v = rows["id"].to_numpy(), np.stack(rows["v"].to_numpy())
        edges, start = kernels.vamana(v, c.degree, max(c.candidate_limit, c.degree), c.alpha, c.seed)
        return pd.DataFrame({"shard": rows["shard"].to_numpy(), "id": ids, "v": list(v), "nbrs": [ids[e] for e in edges], "entry": ids[start]})

    return shards(live, shard_rows).groupBy("shard").applyInPandas(build, INDEX)


def prune(candidates: DataFrame, base: DataFrame, degree: int, alpha: float) -> DataFrame:
    """Robust prune of each node's candidates (src, dst): src, pos, dst in pick order."""
    a = base.select(F.col("id").alias("src"), F.col("v").cast("array<double>").alias("sv"))
    b = base.select(F.col("id").alias("dst"), F.col("v").cast("array<double>").alias("dv"))
    held = candidates.select("src", "dst").distinct().join(b, "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "dv"))).alias("c"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Many nodes a batch; each one's candidates are a slice of two flat columns."""
        for batch in batches:
            if not batch.num_rows:
                continue
            near, own = batch.column(1), kmeans.matrix(batch, 2)
            ends, flat = near.offsets.to_numpy(), near.values
            dst = flat.field(0).to_numpy(zero_copy_only=False)
            v = np.asarray(flat.field(1).flatten().to_numpy(zero_copy_only=False), float).reshape(len(dst), -1)
            out = []
            for src, a, z, q in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), own):
                picked = kernels.robust_prune(np.vstack([v[a:z], q]), z - a, range(z - a), degree, alpha)
                out.append((src, dst[a:z][picked]))
            n = [len(x) for _, x in out]
            columns = np.repeat([s for s, _ in out], n), np.concatenate([np.arange(k) for k in n]), np.concatenate([x for _, x in out])
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["src", "pos", "dst"])

    # Candidates of a node are bounded by the candidate limit.
    return held.join(a, "src").select(F.col("src").cast("long"), "c", "sv").mapInArrow(kernel, "src long, pos int, dst long")


def build(base: DataFrame, config: BuildConfig | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Edges (src, pos, dst) by the configured policy."""
    c = config or BuildConfig()
    live = base if deleted is None else base.join(deleted.select("id"), "id", "left_anti")
    if c.policy == "exact":
        return knn.self_graph(live, c.degree).select("src", "pos", "dst")
    if c.policy == "vamana":
        return edges_of(vamana(live, c))
    n = base.count()
    if c.policy == "approx-rp":
        found = cand.random_projection(live, c.projections, c.window, c.seed).union(cand.samples(live, n, c.random_samples, c.window, c.seed))
        out = prune(cand.limited(found, c.candidate_limit, deleted, c.seed), live, c.degree, c.alpha)
    else:
        found = cand.lsh(live, c.lsh_tables, c.lsh_bits, c.lsh_radius, c.bucket_limit, c.seed).union(cand.samples(live, n, c.random_samples, c.window, c.seed))
        found = cand.limited(found, c.candidate_limit, deleted, c.seed)
        if c.policy == "lsh-vamana":
            out = prune(found, live, c.degree, c.alpha)
            back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            return prune(out.select("src", "dst").union(back), live, c.degree, c.alpha)
        out = cand.nearest_from(found, live, c.degree).select("src", "pos", "dst")
    return cand.reverse(out, live, c.degree) if c.reverse_patch else out


def patch_deleted(edges: DataFrame, base: DataFrame, deleted: DataFrame, degree: int = 32, alpha: float = 1.2) -> DataFrame:
    """Repairs the neighbours of deleted nodes; deleted nodes lose their edges."""
    live = edges.join(deleted.select(F.col("id").alias("src")), "src", "left_anti")
    fixed = prune(cand.delete_patch(edges, deleted), base, degree, alpha)
    return live.join(fixed.select("src").distinct(), "src", "left_anti").join(deleted.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "pos", "dst").unionByName(fixed)


def edges_of(index: DataFrame) -> DataFrame:
    return index.select(F.col("id").alias("src"), F.posexplode("nbrs").alias("pos", "dst"))


def from_edges(base: DataFrame, edges: DataFrame, entry: int) -> DataFrame:
    """An index of one shard; the base must fit in a task."""
    nbrs = edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("nbrs"))
    joined = base.join(nbrs, base["id"] == nbrs["src"], "left")
    return joined.select(F.lit(0).alias("shard"), "id", F.col("v").cast("array<double>").alias("v"), F.coalesce("nbrs", F.array().cast("array<long>")).alias("nbrs"), F.lit(entry).cast("long").alias("entry"))


def search(index: DataFrame, queries: DataFrame, k: int = 10, width: int = 64, beam: int = 0, rerank: int = 0, book: Codebook | None = None, entries: list[int] | None = None, stats: bool = False, **stops) -> DataFrame:
    """Top k of each query. With a codebook candidates are ranked by table lookups and the best `rerank` of them exactly. stats: expansions by query and shard instead."""
    spark = index.sparkSession
    out = None
    block = max(1, knn.BROADCAST_BYTES // 1024)

    def runner(sent):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("id")
            ids, v = rows["id"].to_numpy(), np.stack(rows["v"].to_numpy())
            at = {x: i for i, x in enumerate(ids.tolist())}
            edges = [[at[x] for x in own if x in at] for own in rows["nbrs"].map(lambda e: list(e))]
            start = [at[e] for e in dict.fromkeys([*(entries or []), int(rows["entry"].iloc[0])]) if e in at] or [0]
            codes = book.encode(v) if book else None
            found = []
            for qid, q in sent.value:
                exact = lambda nodes, q=q: ((v[nodes] - q) ** 2).sum(1)
                if book:
                    table, m = book.table(q), np.arange(book.subspaces)
                    got, expanded = kernels.search(lambda nodes, t=table: t[m, codes[nodes]].sum(1), exact, edges, start, k, width, beam, rerank, **stops)
                else:
                    got, expanded = kernels.search(exact, exact, edges, start, k, width, beam, rerank, **stops)
                found += [(qid, expanded, 0.0)] if stats else [(qid, int(ids[x]), d) for d, x in got]
            return pd.DataFrame(found, columns=["qid", "id", "dist"])
        return run

    n = -(-queries.count() // block)
    for b in range(max(1, n)):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == b) if n > 1 else queries
        sent = spark.sparkContext.broadcast([(r[0], np.array(r[1], float)) for r in part.select("qid", "qv").collect()])

        got = index.groupBy("shard").applyInPandas(runner(sent), "qid long, id long, dist double")
        out = got if out is None else out.union(got)
    return out.groupBy("qid").agg(F.sum("id").alias("expanded")) if stats else knn.rank(out, k)


def level_search(edges: DataFrame, base: DataFrame, queries: DataFrame, entries: list[int], k: int, steps: int, beam: int) -> DataFrame:
    """The same search as joins, a step at a time; for checking small graphs. State is cut by checkpoint()."""
    spark = base.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        raise ValueError("set a checkpoint folder first")
    reach = queries.crossJoin(base.where(F.col("id").isin(entries))).select("qid", "id", squared_l2("v", "qv").alias("dist"), F.lit(False).alias("done"))
    for _ in range(steps):
        w = Window.partitionBy("qid").orderBy("done", "dist", "id")
        reach = reach.withColumn("i", F.row_number().over(w))
        opened = reach.where(~F.col("done") & (F.col("i") <= beam)).select("qid", "id")
        fresh = opened.join(edges, opened["id"] == edges["src"]).select("qid", F.col("dst").alias("id")).distinct().join(reach, ["qid", "id"], "left_anti")
        fresh = fresh.join(base, "id").join(queries, "qid").select("qid", "id", squared_l2("v", "qv").alias("dist"), F.lit(False).alias("done"))
        reach = reach.withColumn("done", F.col("done") | (F.col("i") <= beam)).drop("i").unionByName(fresh).checkpoint()
    return knn.rank(reach.select("qid", "id", "dist"), k)


def order(index: DataFrame, packing: str = "bfs", per_page: int = 2, seed: int = 42, queries: DataFrame | None = None, **search_options) -> DataFrame:
    """shard, id, pos: the order in which a shard's nodes are laid out."""
    if packing not in PACKINGS:
        raise ValueError(f"unknown packing: {packing}")
    if packing == "random":
        w = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
        return index.select("shard", "id", (F.row_number().over(w) - 1).cast("long").alias("pos"))
    if packing == "hotpath":
        if queries is None:
            raise ValueError("hotpath packing needs queries")
        visits = search(index, queries, **{"k": 32, "width": 128, **search_options}).groupBy("id").count()
        w = Window.partitionBy("shard").orderBy(F.desc(F.coalesce("count", F.lit(0))), "id")
        return index.join(visits, "id", "left").select("shard", "id", (F.row_number().over(w) - 1).cast("long").alias("pos"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids = rows["id"].tolist()
        at = {x: i for i, x in enumerate(ids)}
        edges = [[at[x] for x in own if x in at] for own in rows["nbrs"]]
        got = kernels.bfs_order(edges) if packing == "bfs" else kernels.coaccess_order(edges, per_page, seed=seed)
        return pd.DataFrame({"shard": rows["shard"].iloc[0], "id": [ids[i] for i in got], "pos": range(len(got))})

    return index.select("shard", "id", "nbrs").groupBy("shard").applyInPandas(one, "shard int, id long, pos long")


def pages(ordered: DataFrame, per_page: int, nodes: DataFrame | None = None) -> DataFrame:
    """shard, id, page_id, slot. Shards follow each other on full pages, so a place is one node's and only the last page may have room. nodes: the index, whose rows by shard are cheaper to count than those of `ordered`."""
    sizes = (ordered if nodes is None else nodes).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))  # a row for each shard
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = ordered.join(F.broadcast(sizes.select("shard", before.alias("before"))), "shard")
    return placed.select("shard", "id", (F.col("before") + F.col("pos")).alias("at")).select("shard", "id", F.expr(f"at div {per_page}").alias("page_id"), (F.col("at") % per_page).cast("int").alias("slot"))


def covered(ordered: DataFrame, index: DataFrame) -> bool:
    """Whether every node has just one place."""
    twice = ordered.groupBy("id").count().where("count > 1").limit(1)
    lost = index.select("id").join(ordered, "id", "left_anti").limit(1)
    return twice.union(lost.select("id", F.lit(0).alias("count"))).limit(1).count() == 0


def save(index: DataFrame, path: str, config: BuildConfig | None = None, code_bytes: int = 32, packing: str = "bfs") -> None:
    """Nodes as Parquet, in page order within their shard, and a row of metadata."""
    c = config or BuildConfig()
    head = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    per_page = max(1, nodes_per_page(c.page_size, head["dim"] or 0, c.degree, code_bytes))
    placed = index.join(pages(order(index, packing, per_page, c.seed), per_page, index), ["shard", "id"])
    placed.repartition("shard").sortWithinPartitions("shard", "page_id", "slot").write.partitionBy("shard").parquet(f"{path}/nodes")
    meta = {"format": "vecloom-graph", "version": 1, "vectors": head["n"], "dim": head["dim"], "per_page": per_page, "config": asdict(c)}
    spark = index.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").head()[0])
    if meta.get("format") != "vecloom-graph" or meta.get("version") != 1:
        raise ValueError(f"not a graph of version 1: {path}")
    nodes = spark.read.parquet(f"{path}/nodes")
    missing = {"id", "v", "nbrs", "entry", "page_id", "slot", "shard"} - set(nodes.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return nodes, meta
