"""Graph algorithms whose order matters, over numpy arrays of one shard. Nodes are positions 0 to n - 1."""

from __future__ import annotations

import heapq
import random
from collections import deque
from collections.abc import Callable, Iterable

import numpy as np


def robust_prune(v: np.ndarray, source: int, candidates: Iterable[int], degree: int, alpha: float) -> list[int]:
    """Picks the nearest candidate again and again; after each pick p a candidate c stays only if alpha^2 d(p, c) > d(source, c)."""
    rest = np.array(sorted(set(candidates) - {source}), np.int64)
    if not len(rest):
        return []
    near = ((v[rest] - v[source]) ** 2).sum(1)
    order = np.lexsort((rest, near))
    rest, near = rest[order], near[order]
    picked: list[int] = []
    while len(rest) and len(picked) < degree:
        p = rest[0]
        picked.append(int(p))
        keep = alpha * alpha * ((v[rest] - v[p]) ** 2).sum(1) > near
        keep[0] = False
        rest, near = rest[keep], near[keep]
    return picked


def explore(v: np.ndarray, edges: list[list[int]], start: int, target: int, expansions: int) -> list[int]:
    """Best-first walk towards a node: the nodes it expanded, nearest first."""
    goal = v[target]
    seen, done = {start}, []
    heap = [(float(((v[start] - goal) ** 2).sum()), start)]
    while heap and len(done) < expansions:
        d, x = heapq.heappop(heap)
        done.append((d, x))
        fresh = [y for y in edges[x] if y not in seen]
        if fresh:
            seen.update(fresh)
            for dist, y in zip(((v[fresh] - goal) ** 2).sum(1).tolist(), fresh):
                heapq.heappush(heap, (dist, y))
    return [x for _, x in sorted(done)]


def medoid(v: np.ndarray, live: np.ndarray) -> int:
    if not live.any():
        raise ValueError("all nodes are deleted")
    d = np.round(((v - v[live].mean(0)) ** 2).sum(1), 9)
    return int(np.where(live, d, np.inf).argmin())


def ring(n: int, degree: int, live: np.ndarray) -> list[list[int]]:
    """The seed graph: each live node with its live ring neighbours on both sides, degree of them."""
    out: list[list[int]] = []
    for i in range(n):
        own = [] if not live[i] else list(dict.fromkeys(x for r in range(1, degree + 1) for x in ((i + r) % n, (i - r) % n) if x != i and live[x]))[:degree]
        out.append(own)
    return out


def add_reverse(v: np.ndarray, edges: list[list[int]], source: int, degree: int, alpha: float) -> int:
    """For each edge of the source in order, the reverse one: appended while there is room, else the target is pruned."""
    added = 0
    for t in edges[source]:
        if source not in edges[t]:
            added += 1
            if len(edges[t]) < degree:
                edges[t].append(source)
            else:
                edges[t] = robust_prune(v, t, [*edges[t], source], degree, alpha)
    return added


def vamana(v: np.ndarray, degree: int = 32, expansions: int = 200, alpha: float = 1.2, seed: int = 42, deleted: Iterable[int] = ()) -> tuple[list[list[int]], int]:
    """One pass over all live nodes in seeded order: walk, prune, reverse edges. Edges of each node in pick order, and the entry node."""
    live = np.ones(len(v), bool)
    live[list(deleted)] = False
    if not len(v):
        return [], -1
    start = medoid(v, live)
    edges = ring(len(v), degree, live)
    order = [int(i) for i in np.nonzero(live)[0]]
    random.Random(seed).shuffle(order)
    for i in order:
        found = [x for x in explore(v, edges, start, i, expansions) if x != i]
        edges[i] = robust_prune(v, i, [*found, *edges[i]], degree, alpha)
        add_reverse(v, edges, i, degree, alpha)
    return edges, start


def prune_overfull(v: np.ndarray, edges: list[list[int]], degree: int, alpha: float) -> int:
    n = 0
    for i, own in enumerate(edges):
        if len(own) > degree:
            edges[i] = robust_prune(v, i, own, degree, alpha)
            n += 1
    return n


def search(
    score: Callable[[list[int]], np.ndarray],
    exact: Callable[[list[int]], np.ndarray] | None,
    edges: list[list[int]],
    entries: list[int],
    k: int,
    width: int = 64,
    beam: int = 0,
    rerank: int = 0,
    patience: int = 0,
    epsilon: float = 0.0,
    min_expansions: int = 0,
    early_stop: bool = False,
) -> tuple[list[tuple[float, int]], int]:
    """Beam search by `score` (table lookups or exact distances). Up to `beam` nodes are expanded before any of their neighbours is queued.

    early_stop ends when the next node is worse than the worst kept; patience > 0 ends after so many expansions in
    which the best distance improved by no more than epsilon, relatively. Gives (distance, node) and the expansions.
    """
    n = len(edges)
    start = [e for e in dict.fromkeys(entries) if 0 <= e < n]
    if not start or k <= 0:
        return [], 0
    capacity = min(n, max(min(k, n), rerank))
    seen = set(start)
    frontier = list(zip(score(start).tolist(), start))
    heapq.heapify(frontier)
    best = sorted(frontier)[:capacity]
    expanded = stale = 0
    last = best[0][0]
    while frontier and expanded < width:
        if early_stop and len(best) == capacity and frontier[0] > best[-1]:
            break
        batch = [heapq.heappop(frontier)[1] for _ in range(min(beam or width, width - expanded, len(frontier)))]
        expanded += len(batch)
        fresh: list[int] = []
        for x in batch:
            for y in edges[x]:
                if y not in seen:
                    seen.add(y)
                    fresh.append(y)
        if fresh:
            scored = list(zip(score(fresh).tolist(), fresh))
            for s in scored:
                heapq.heappush(frontier, s)
            best = sorted([*best, *scored])[:capacity]
        if patience and expanded >= min_expansions:
            stale = stale + len(batch) if last - best[0][0] <= epsilon * max(last, 1e-12) else 0
            if stale >= patience:
                break
        last = best[0][0]
    if rerank and exact is not None:
        nodes = [x for _, x in best]
        best = sorted(zip(exact(nodes).tolist(), nodes))
    return best[:k], expanded


def bfs_order(edges: list[list[int]]) -> list[int]:
    """Breadth first over all components, each from its lowest unseen node."""
    seen, out = [False] * len(edges), []
    for root in range(len(edges)):
        if seen[root]:
            continue
        seen[root], queue = True, deque([root])
        while queue:
            x = queue.popleft()
            out.append(x)
            for y in edges[x]:
                if not seen[y]:
                    seen[y] = True
                    queue.append(y)
    return out


def walk_weights(edges: list[list[int]], sessions: int = 64, length: int = 32, seed: int = 42) -> tuple[np.ndarray, dict[tuple[int, int], float]]:
    """Deterministic walks: a visit makes a node hotter by 2; consecutive nodes belong together by 4, a visited node and its first four neighbours by 1."""
    hot = np.zeros(len(edges))
    weight: dict[tuple[int, int], float] = {}
    rng = random.Random(seed)

    def tie(a: int, b: int, w: float) -> None:
        key = min(a, b), max(a, b)
        weight[key] = weight.get(key, 0.0) + w

    for _ in range(sessions if edges else 0):
        x = rng.randrange(len(edges))
        for _ in range(length):
            hot[x] += 2
            for y in edges[x][:4]:
                tie(x, y, 1)
            if not edges[x]:
                break
            y = edges[x][rng.randrange(len(edges[x]))]
            tie(x, y, 4)
            x = y
    return hot, weight


def coaccess_order(edges: list[list[int]], per_page: int, sessions: int = 64, length: int = 32, seed: int = 42) -> list[int]:
    """Pages filled greedily: the hottest node left opens a page, then whatever scores best by 0.001 hotness + 20 togetherness + 10 adjacency."""
    hot, weight = walk_weights(edges, sessions, length, seed)
    near: list[dict[int, float]] = [{} for _ in edges]
    for (a, b), w in weight.items():
        near[a][b] = near[a].get(b, 0) + 20 * w
        near[b][a] = near[b].get(a, 0) + 20 * w
    for x, own in enumerate(edges):
        for y in own:
            near[x][y] = near[x].get(y, 0) + 10
            near[y][x] = near[y].get(x, 0) + 10
    left = set(range(len(edges)))
    by_heat = deque(sorted(left, key=lambda x: (-hot[x], x)))
    out: list[int] = []
    while left:
        while by_heat[0] not in left:
            by_heat.popleft()
        page, gains = [by_heat[0]], {}
        left.discard(page[0])
        while len(page) < per_page and left:
            for y, w in near[page[-1]].items():
                if y in left:
                    gains[y] = gains.get(y, 0.0) + w
            gains.pop(page[-1], None)
            if gains:
                pick = min(gains, key=lambda y: (-(gains[y] + 0.001 * hot[y]), y))
                gains.pop(pick)
            else:
                while by_heat[0] not in left:
                    by_heat.popleft()
                pick = by_heat[0]
            left.discard(pick)
            page.append(pick)
        out += page
    return out
