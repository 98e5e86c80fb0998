"""Settings with their defaults, checks and clamps."""

from __future__ import annotations

from dataclasses import dataclass, field

from vecloom.operators.graph.index import BuildConfig

MODES = ("exact", "graph", "pq", "ivf")


@dataclass
class PqConfig:
    subspaces: int = 8
    centroids: int = 256
    train_limit: int = 100_000
    iterations: int = 4
    seed: int = 42

    def __post_init__(self):
        if self.subspaces < 1 or not 2 <= self.centroids <= 256 or self.train_limit < 1 or self.iterations < 0:
            raise ValueError("sub-spaces and training rows must be positive, centroids from 2 to 256")


@dataclass
class SearchConfig:
    k: int = 10
    width: int = 64
    beam: int = 0  # 0: as the width
    entries: int = 32
    rerank: int = 0
    nprobe: int = 8
    patience: int = 0
    epsilon: float = 0.0
    min_expansions: int = 0
    early_stop: bool = False
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self):
        if self.k < 0 or self.width < 1 or self.rerank < 0 or self.nprobe < 1:
            raise ValueError("k and rerank must not be negative, width and nprobe positive")
        if self.beam > self.width:
            self.warnings.append(f"beam {self.beam} is cut to the width {self.width}")
            self.beam = self.width
        if 0 < self.rerank < self.k:
            self.warnings.append(f"rerank {self.rerank} is raised to k {self.k}")
            self.rerank = self.k

    def stops(self) -> dict:
        return {"patience": self.patience, "epsilon": self.epsilon, "min_expansions": self.min_expansions, "early_stop": self.early_stop}


@dataclass
class EngineConfig:
    mode: str = "exact"
    dim: int = 64
    cells: int = 16
    pq: PqConfig = field(default_factory=PqConfig)
    graph: BuildConfig = field(default_factory=BuildConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    flush_bytes: int = 64 << 20

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode: {self.mode}")
        if self.dim < 1:
            raise ValueError("the dimension must be positive")
