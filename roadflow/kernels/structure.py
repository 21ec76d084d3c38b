"""Kernels on whole graphs: betweenness, strong components, hulls, routes."""

from __future__ import annotations

import heapq

import numpy as np

from roadflow.kernels.graph import Links, Reach, spread


def cheapest(u: np.ndarray, v: np.ndarray, weight: np.ndarray, nodes: int) -> list[dict[int, tuple[float, list[int]]]]:
    """For each node its successors: the least weight of the edges between, and the edges of that weight."""
    out: list[dict[int, tuple[float, list[int]]]] = [{} for _ in range(nodes)]
    for e, (a, b, w) in enumerate(zip(u.tolist(), v.tolist(), weight.tolist())):
        have = out[a].get(b)
        if have is None or w < have[0]:
            out[a][b] = (w, [e])
        elif w == have[0]:
            have[1].append(e)
    return out


#: Pairs of a source and a node that are followed together.
PAIRS_AT_ONCE = 1 << 20


def betweenness(u: np.ndarray, v: np.ndarray, weight: np.ndarray, nodes: int, sources: np.ndarray) -> np.ndarray:
    """For each edge, over all shortest paths from the sources, the share of paths that use it. Edges of equal weight between two nodes share alike.

    All sources of a batch go together: their distances are one table of pairs; the links that shortest paths use form a graph on these pairs without
    cycles, through which numbers of paths are summed forth, layer by layer, and dependencies back (Brandes' recurrence).
    """
    links = Links(u, v, weight, np.arange(len(u)), nodes)
    at = np.searchsorted(links.key, u * nodes + v)  # of each edge the link between its ends
    cheapest_ = weight == links.length[at]
    shared = np.bincount(at[cheapest_], minlength=len(links.head))
    total = np.zeros(len(links.head))
    size = max(1, PAIRS_AT_ONCE // max(1, nodes))
    for k in range(0, len(sources), size):
        some = np.unique(sources[k : k + size])
        key, far, came = Reach(links)._search(some, np.full(len(some), np.inf))
        node = key % nodes
        count = links.start[node + 1] - links.start[node]
        link = np.repeat(links.start[node], count) + spread(count)
        a = np.repeat(np.arange(len(key)), count)
        b = np.searchsorted(key, key[a] // nodes * nodes + links.head[link])
        # a link without length counts only where the search came by it, lest two such go round in circles
        used = (far[a] + links.length[link] == far[b]) & ((links.length[link] > 0) | (came[b] == node[a])) & (node[b] != key[b] // nodes)
        a, b, link = a[used], b[used], link[used]
        start = np.searchsorted(a, np.arange(len(key) + 1))
        left = np.bincount(b, minlength=len(key))
        paths = np.zeros(len(key))
        front = np.flatnonzero(node == key // nodes)
        paths[front] = 1.0
        layers = []
        while len(front):
            n = start[front + 1] - start[front]
            step = np.repeat(start[front], n) + spread(n)
            layers.append(step)
            np.add.at(paths, b[step], paths[a[step]])
            np.subtract.at(left, b[step], 1)
            reached = np.unique(b[step])
            front = reached[left[reached] == 0]
        depends = np.zeros(len(key))
        for step in reversed(layers):
            c = paths[a[step]] / paths[b[step]] * (1 + depends[b[step]])
            np.add.at(depends, a[step], c)
            np.add.at(total, link[step], c)
    out = np.zeros(len(u))
    out[cheapest_] = (total / np.maximum(shared, 1))[at[cheapest_]]
    return out


def strong_components(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """For each node the smallest node it reaches and is reached from (Tarjan, without recursion)."""
    order = np.argsort(u, kind="stable")
    heads, at = v[order].tolist(), np.searchsorted(u[order], np.arange(nodes + 1)).tolist()
    index, low, on, label, stack, clock = [-1] * nodes, [0] * nodes, [False] * nodes, np.zeros(nodes, np.int64), [], 0
    for root in range(nodes):
        if index[root] >= 0:
            continue
        work = [(root, at[root])]
        index[root] = low[root] = clock
        clock += 1
        stack.append(root)
        on[root] = True
        while work:
            a, k = work[-1]
            if k < at[a + 1]:
                work[-1] = (a, k + 1)
                b = heads[k]
                if index[b] < 0:
                    index[b] = low[b] = clock
                    clock += 1
                    stack.append(b)
                    on[b] = True
                    work.append((b, at[b]))
                elif on[b]:
                    low[a] = min(low[a], index[b])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[a])
            if low[a] == index[a]:
                part = []
                while not part or part[-1] != a:
                    part.append(stack.pop())
                    on[part[-1]] = False
                label[part] = min(part)
    return label


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise; fewer than three points or a line give what is left of it."""
    p = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(p) < 3:
        return p
    halves = []
    for part in (p, p[::-1]):
        side: list[np.ndarray] = []
        for q in part:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (q[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (q[0] - side[-2][0]) <= 0:
                side.pop()
            side.append(q)
        halves += side[:-1]
    return np.array(halves)


def area(corners: np.ndarray) -> float:
    if len(corners) < 3:
        return 0.0
    x, y = (corners - corners[0]).T
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def route(links: list[dict[int, tuple[float, list[int]]]], a: int, b: int) -> tuple[float, list[int], list[int]] | None:
    """Cost, nodes and edges of a cheapest route. Of equally cheap ways into a node the first found from the smallest predecessor stays."""
    best, came, done = {a: 0.0}, {a: -1}, set()
    heap = [(0.0, a)]
    while heap:
        d, n = heapq.heappop(heap)
        if n in done:
            continue
        done.add(n)
        if n == b:
            break
        for m, (w, _) in links[n].items():
            if d + w < best.get(m, np.inf):
                best[m], came[m] = d + w, n
                heapq.heappush(heap, (d + w, m))
    if b not in done:
        return None
    nodes = [b]
    while nodes[-1] != a:
        nodes.append(came[nodes[-1]])
    nodes.reverse()
    return best[b], nodes, [links[p][q][1][0] for p, q in zip(nodes, nodes[1:])]
