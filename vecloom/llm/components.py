"""Connected components of a link table, as rounds of joins and bounded local contraction.

Defined cases: a link of a node to itself and repeated links count for nothing; links with a null go; a node's root is the
smallest node of its component; an empty table gives an empty result. A hub, a node of very many links, is contracted to its
root in each task first; what is left meets in a sort-merge join, whose large partitions Spark's skew join splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecloom.llm.common import materialize

#: Links that one task contracts at most (about 200 MB of Python objects).
TASK_LINKS = 1_000_000


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for every node that is not the smallest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in parent]


def spanning(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the pairs that join what the ones before didn't."""
    group: dict[int, int] = {}
    out = []
    for a, b in pairs:
        x, y = group.setdefault(a, a), group.setdefault(b, b)
        if x != y:
            out.append((a, b))
            for node, g in group.items():
                if g == y:
                    group[node] = x
    return out


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = [p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    found = forest(pairs)
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])


def _large_star(links: DataFrame) -> DataFrame:
    """Hangs each node's larger neighbours under the smallest node around it."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hangs each node and its smaller neighbours under the smallest of them. Links come with a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """links: longs a, b, in any order. Gives (node, root) for every linked node but the roots; root is the smallest node.

    Each round contracts links inside tasks of at most task_links, then, if more than one task was needed, applies the
    large-star and small-star steps across tasks. It ends when a round changes nothing. Nothing is collected.
    """
    links = materialize(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links", even=True)
    before = None
    while True:
        n, mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, mark) == before or not n:
            break
        before = n, mark
        parts = ceil(n / task_links)
        local = links.coalesce(1) if parts == 1 else links.repartition(parts)
        local = materialize(local.mapInArrow(_contract, "a long, b long"), "links")
        if parts == 1:
            links = local
            break
        links = materialize(_small_star(_large_star(local)), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
