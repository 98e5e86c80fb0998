"""Tree ensembles: reading and writing text dumps, scoring by column expressions, and stump boosting."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The dump's line formats. What stands behind a leaf's value or a split's targets, after a comma, is left out.
BASE = re.compile(r"base_score=([^\s,]+)")
BOOSTER = re.compile(r"(?:booster|tree)\[")
SPLIT = re.compile(r"(\d+)\s*:\s*\[\s*(\w+)\s*<([^\]]+)\]\s*yes=(\d+),\s*no=(\d+)(?:,\s*missing=(\d+))?")
LEAF = re.compile(r"(\d+)\s*:\s*leaf=([^\s,]+)")
FEATURES = ("num_candidates_on_page", "min_pq_rank_on_page", "avg_pq_rank_on_page", "candidate_rank_span", "contains_top1_candidate", "contains_topk_candidate", "is_cached", "is_inflight", "io_queue_depth", "cache_pressure")

Node = tuple  # ("leaf", value) or ("split", feature, threshold, yes, no, missing)


@dataclass
class Ensemble:
    base_score: float = 0.0
    trees: list[dict[int, Node]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Ensemble:
        out = cls()

        def tree() -> dict[int, Node]:
            """The last one; nodes before any header make one of their own."""
            if not out.trees:
                out.trees.append({})
            return out.trees[-1]

        for line in text.splitlines():
            line = line.partition("#")[0].strip()
            if m := BASE.match(line):
                out.base_score = float(m[1])
            elif BOOSTER.match(line):
                out.trees.append({})
            elif m := SPLIT.match(line):
                if not math.isfinite(float(m[3])):
                    raise ValueError(f"a threshold that isn't finite: {line}")
                tree()[int(m[1])] = ("split", m[2], float(m[3]), int(m[4]), int(m[5]), int(m[6] or m[4]))
            elif m := LEAF.match(line):
                tree()[int(m[1])] = ("leaf", float(m[2]))
            elif ":" in line:
                raise ValueError(f"not a node of a tree: {line}")
        if not out.trees:
            raise ValueError("a model without trees")
        for tree in out.trees:
            for node in tree.values():
                if node[0] == "split" and not {*node[3:]} <= set(tree):
                    raise ValueError("a branch leads nowhere")
        return out

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        """From a text file of few lines, on any file system."""
        return cls.parse(spark.read.text(path, wholetext=True).head()[0])

    def dump(self) -> str:
        lines = [f"base_score={self.base_score!r}"]
        for i, tree in enumerate(self.trees):
            lines.append(f"booster[{i}]:")
            for n, node in sorted(tree.items()):
                lines.append(f"{n}:leaf={node[1]!r}" if node[0] == "leaf" else f"{n}:[{node[1]}<{node[2]!r}] yes={node[3]},no={node[4]},missing={node[5]}")
        return "\n".join(lines) + "\n"

    def score(self, columns: list[str]) -> Column:
        """base_score plus each tree's leaf, as nested conditions that compile with the rest of the plan. A missing or non-finite feature takes the missing branch; an unknown one is missing."""

        def value(name: str) -> Column:
            if name not in columns:
                return F.lit(None).cast("double")
            x = F.col(name).cast("double")
            return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

        def walk(tree: dict[int, Node], n: int) -> Column:
            node = tree[n]
            if node[0] == "leaf":
                return F.lit(node[1])
            x = value(node[1])
            return F.when(x.isNull(), walk(tree, node[5])).when(x < node[2], walk(tree, node[3])).otherwise(walk(tree, node[4]))

        total = F.lit(self.base_score)
        for tree in self.trees:
            if tree:
                total = total + walk(tree, 0)
        return total


def fit_stumps(rows: DataFrame, label: str, features: list[str], rounds: int = 16, rate: float = 0.2, picks: int = 32) -> Ensemble:
    """Boosts stumps on squared error. Thresholds lie halfway between up to `picks` quantiles of each feature; a round is one aggregation."""
    model = Ensemble(float(rows.agg(F.coalesce(F.avg(label), F.lit(0.0))).head()[0]))
    quantiles = [i / (picks - 1) for i in range(picks)]
    found = rows.agg(*(F.array_sort(F.array_distinct(F.percentile_approx(F.col(f).cast("double"), quantiles))).alias(f) for f in features)).head()
    cuts = [(f, (a + b) / 2) for f in features for a, b in zip(found[f] or [], (found[f] or [])[1:])]
    for _ in range(rounds if cuts else 0):
        left = F.col(label) - model.score(rows.columns)
        each = [F.sum("e").alias("s"), F.count("e").alias("n")]
        for i, (f, t) in enumerate(cuts):
            low = F.col(f).cast("double") < t
            each += [F.sum(F.when(low, F.col("e"))).alias(f"s{i}"), F.count(F.when(low, F.col("e"))).alias(f"n{i}")]
        r = rows.withColumn("e", left).agg(*each).head()
        best = None
        for i, (f, t) in enumerate(cuts):
            a, n = r[f"s{i}"] or 0.0, r[f"n{i}"]
            if 0 < n < r["n"]:
                gain = a * a / n + (r["s"] - a) ** 2 / (r["n"] - n)
                if best is None or gain > best[0] + 1e-12:
                    best = gain, f, t, a / n, (r["s"] - a) / (r["n"] - n)
        if best is None:
            break
        _, f, t, yes, no = best
        model.trees.append({0: ("split", f, t, 1, 2, 1), 1: ("leaf", rate * yes), 2: ("leaf", rate * no)})
    return model


def fit_boosted(rows: DataFrame, label: str, features: list[str], rounds: int = 16, depth: int = 3, rate: float = 0.2, seed: int = 42):
    """Gradient-boosted trees of Spark's own library: a fitted model and its feature assembler."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return assembler, GBTRegressor(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed).fit(assembler.transform(rows))
