"""Leiden in plain Python, one node at a time: the measure for the distributed form."""

from __future__ import annotations

import random
from collections import defaultdict, deque


def _moved(adj: list[dict[int, float]], size: list[float], part: list[int], m2: float, rng: random.Random) -> bool:
    """Local moving: each node to the neighbouring community of the best modularity gain, until none gains."""
    total: dict[int, float] = defaultdict(float)
    for v, c in enumerate(part):
        total[c] += size[v]
    order, waiting, changed = list(range(len(adj))), set(range(len(adj))), False
    rng.shuffle(order)
    queue = deque(order)
    while queue:
        v = queue.popleft()
        waiting.discard(v)
        own = part[v]
        total[own] -= size[v]
        links: dict[int, float] = defaultdict(float)
        for u, w in adj[v].items():
            if u != v:
                links[part[u]] += w
        best, gain = own, links[own] - total[own] * size[v] / m2
        for c in sorted(links):
            g = links[c] - total[c] * size[v] / m2
            if g > gain + 1e-12:
                best, gain = c, g
        total[best] += size[v]
        if best != own:
            part[v], changed = best, True
            for u in adj[v]:
                if part[u] != best and u not in waiting:
                    waiting.add(u)
                    queue.append(u)
    return changed


def _refined(adj: list[dict[int, float]], size: list[float], part: list[int], m2: float) -> list[int]:
    """Inside each community, nodes that are still alone join the best connected sub-community."""
    sub, alone, total = list(range(len(adj))), [True] * len(adj), list(size)
    for v in range(len(adj)):
        if not alone[v]:
            continue
        links: dict[int, float] = defaultdict(float)
        for u, w in adj[v].items():
            if u != v and part[u] == part[v]:
                links[sub[u]] += w
        best, gain = sub[v], 0.0
        for c in sorted(links):
            if c != sub[v] and (g := links[c] - total[c] * size[v] / m2) > gain + 1e-12:
                best, gain = c, g
        if best != sub[v]:
            total[best] += size[v]
            total[sub[v]] -= size[v]
            sub[v], alone[v] = best, False
            alone[best] = False
    return sub


def leiden(edges: list[tuple], m2: float | None = None, seed: int = 42, most_levels: int = 10) -> list[dict]:
    """Partitions of the nodes, finest first: move, refine, aggregate, until nothing moves.

    ``m2``: twice the edge weight of the whole graph, where these edges are a part of it.
    """
    names = sorted({x for e in edges for x in e[:2]})
    index = {x: i for i, x in enumerate(names)}
    adj: list[dict[int, float]] = [{} for _ in names]
    for a, b, *w in edges:
        i, j, weight = index[a], index[b], float(w[0]) if w else 1.0
        adj[i][j] = adj[i].get(j, 0.0) + weight
        adj[j][i] = adj[j].get(i, 0.0) + weight
    size = [sum(x.values()) for x in adj]
    m2 = m2 or sum(size)
    rng, holder, levels = random.Random(seed), list(range(len(names))), []
    part = list(range(len(names)))
    for _ in range(most_levels):
        moved = _moved(adj, size, part, m2, rng)
        levels.append({x: part[holder[i]] for i, x in enumerate(names)})
        if not moved or len(set(part)) == len(adj):
            break
        sub = _refined(adj, size, part, m2)
        ids = {c: k for k, c in enumerate(sorted(set(sub)))}
        holder = [ids[sub[h]] for h in holder]
        nxt: list[dict[int, float]] = [{} for _ in ids]
        grown, where = [0.0] * len(ids), [0] * len(ids)
        for v, c in enumerate(sub):
            k = ids[c]
            grown[k] += size[v]
            where[k] = part[v]
            for u, w in adj[v].items():
                j = ids[sub[u]]
                nxt[k][j] = nxt[k].get(j, 0.0) + w
        first: dict[int, int] = {}
        part = [first.setdefault(c, k) for k, c in enumerate(where)]
        adj, size = nxt, grown
    return levels
