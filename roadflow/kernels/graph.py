"""A road graph as arrays, with tables of bounded distances between nodes and positions along edges."""

from __future__ import annotations

import numpy as np

#: Pairs of nodes whose distances a worker keeps; a table that is full starts anew.
PAIRS_KEPT = 20_000_000
#: Sources that are followed together.
SOURCES_AT_ONCE = 4096
#: Points placed on edges together.
POINTS_AT_ONCE = 65_536


def length(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Of vectors in metres, by root and squares alone, which are exact to the last bit everywhere; np.hypot is not."""
    return np.sqrt(dx * dx + dy * dy)


def spread(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of counts, back to back."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Links:
    """For each node its neighbours and the shortest edge to each, as one ragged array sorted by node, then neighbour."""

    def __init__(self, a: np.ndarray, b: np.ndarray, length: np.ndarray, edge: np.ndarray, nodes: int) -> None:
        order = np.lexsort((edge, length, b, a))
        a, b = a[order], b[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        self.nodes, self.head, self.length, self.edge = nodes, b[first], length[order][first], edge[order][first]
        self.start = np.searchsorted(a[first], np.arange(nodes + 1))
        self.key = a[first] * nodes + self.head

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The shortest edge from a to b; there is one."""
        return self.edge[np.searchsorted(self.key, a * self.nodes + b)]


class Reach:
    """Shortest distances from nodes to all nodes within a cutoff, kept in one sorted table and added to as they are asked for."""

    def __init__(self, links: Links) -> None:
        self.links = links
        self._clear()

    def _clear(self) -> None:
        self.cutoff = np.full(self.links.nodes, -1.0)
        self.key, self.far, self.came = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def _search(self, source: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key (source and node), distance and the node before, of all sources side by side.

        A round relaxes the links of every pair that the round before made nearer, until none is. Of equal ways the one with the
        fewest links stays, then the one by the smallest node before.
        """
        links, n = self.links, self.links.nodes
        limit = np.zeros(n)
        limit[source] = cutoff
        key = np.sort(source) * n + np.sort(source)
        far, came = np.zeros(len(key)), np.full(len(key), -1)
        front, near = key, far.copy()
        while len(front):
            at = front % n
            count = links.start[at + 1] - links.start[at]
            link = np.repeat(links.start[at], count) + spread(count)
            origin, whence, d = np.repeat(front // n, count), np.repeat(at, count), np.repeat(near, count) + links.length[link]
            ok = d <= limit[origin]
            to, whence, d = origin[ok] * n + links.head[link[ok]], whence[ok], d[ok]
            order = np.lexsort((whence, d, to))
            to, whence, d = to[order], whence[order], d[order]
            first = np.concatenate([[True], to[1:] != to[:-1]]) if len(to) else np.zeros(0, bool)
            to, whence, d = to[first], whence[first], d[first]
            place = np.minimum(np.searchsorted(key, to), len(key) - 1)
            known = key[place] == to
            nearer = known & (d < far[place])
            far[place[nearer]], came[place[nearer]] = d[nearer], whence[nearer]
            new = ~known
            if new.any():
                at = np.searchsorted(key, to[new])
                key, far, came = np.insert(key, at, to[new]), np.insert(far, at, d[new]), np.insert(came, at, whence[new])
            front, near = to[new | nearer], d[new | nearer]
        return key, far, came

    def need(self, source: np.ndarray, cutoff: np.ndarray) -> None:
        """Makes sure that the table has each source up to its cutoff."""
        want = np.full(self.links.nodes, -1.0)
        np.maximum.at(want, source, cutoff)
        todo = np.flatnonzero(want > self.cutoff)
        if not len(todo):
            return
        if len(self.key) > PAIRS_KEPT:
            self._clear()
            todo = np.flatnonzero(want >= 0)
        # a little farther than asked, so that the next longer step finds its distances here
        far = np.exp2(np.ceil(2 * np.log2(np.maximum(want[todo], 1.0))) / 2)
        old = np.isin(self.key // self.links.nodes, todo)
        parts = [(self.key[~old], self.far[~old], self.came[~old])]
        for k in range(0, len(todo), SOURCES_AT_ONCE):
            parts.append(self._search(todo[k : k + SOURCES_AT_ONCE], far[k : k + SOURCES_AT_ONCE]))
        key = np.concatenate([p[0] for p in parts])
        order = np.argsort(key, kind="stable")
        self.key, self.far, self.came = key[order], np.concatenate([p[1] for p in parts])[order], np.concatenate([p[2] for p in parts])[order]
        self.cutoff[todo] = far

    def _place(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a * self.links.nodes + b
        place = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        return place, self.key[place] == key if len(self.key) else np.zeros(key.shape, bool)

    def distance(self, a: np.ndarray, b: np.ndarray, cutoff: np.ndarray) -> np.ndarray:
        """From node to node, infinite beyond the cutoff. ``need`` comes first."""
        place, known = self._place(a, b)
        if not len(self.key):
            return np.full(np.shape(a), np.inf)
        d = np.where(known, self.far[place], np.inf)
        return np.where(d <= cutoff, d, np.inf)

    def steps(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Way and edge: the edges of a shortest way for each pair of nodes that the table has."""
        ways, edges, of, at = [], [], np.arange(len(a)), b
        for _ in range(self.links.nodes):
            on = at != a[of]
            of, at = of[on], at[on]
            if not len(of):
                break
            before = self.came[self._place(a[of], at)[0]]
            ways.append(of)
            edges.append(self.links.between(before, at))
            at = before
        return (np.concatenate(ways), np.concatenate(edges)) if ways else (np.zeros(0, np.int64),) * 2


class Graph:
    """Edges by dense id: ends (node ids), length, reverse edge (-1: none), and vertices as one ragged array."""

    def __init__(self, u: np.ndarray, v: np.ndarray, length: np.ndarray, reverse: np.ndarray, xy: np.ndarray, start: np.ndarray, nodes: int) -> None:
        self.u, self.v, self.length, self.reverse, self.xy, self.start, self.nodes = u, v, length, reverse, xy, start, nodes
        self._along: Reach | None = None
        self._either: Reach | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    @property
    def along(self) -> Reach:
        """Distances along the edges' directions."""
        if self._along is None:
            self._along = Reach(Links(self.u, self.v, self.length, np.arange(len(self.u)), self.nodes))
        return self._along

    @property
    def either(self) -> Reach:
        """Distances whichever way edges run."""
        if self._either is None:
            twice = lambda p, q: np.concatenate([p, q])
            self._either = Reach(Links(twice(self.u, self.v), twice(self.v, self.u), twice(self.length, self.length), np.tile(np.arange(len(self.u)), 2), self.nodes))
        return self._either

    def pieces(self, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edge, ends (x0, y0, x1, y1) and metres from the edge's start of pieces of at most ``most`` metres, in the order of edges."""
        count = np.diff(self.start) - 1
        edge = np.repeat(np.arange(len(self.u)), count)
        p = np.repeat(self.start[:-1], count) + spread(count)
        a, b = self.xy[p], self.xy[p + 1]
        size = length(*(b - a).T)
        total = np.cumsum(size) - size
        arc = total - np.repeat(total[np.minimum(np.cumsum(count) - count, max(0, len(total) - 1))], count) if len(size) else size
        parts = np.maximum(1, np.ceil(size / most)).astype(np.int64)
        of, k = np.repeat(np.arange(len(size)), parts), spread(parts)
        m = parts[of]
        at = lambda k: a[of] + (k / m)[:, None] * (b[of] - a[of])
        ends = np.concatenate([at(k), np.where((k + 1 == m)[:, None], b[of], at(k + 1))], axis=1)
        return edge[of], ends, arc[of] + k / m * size[of]

    def arcs(self, edge: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Metres from each edge's start to its point nearest to the place; NaN for edge -1."""
        out = np.full(len(edge), np.nan)
        every = np.flatnonzero(edge >= 0)
        for k in range(0, len(every), POINTS_AT_ONCE):
            of = every[k : k + POINTS_AT_ONCE]
            first = self.start[edge[of]]
            count = self.start[edge[of] + 1] - first - 1
            p = np.repeat(first, count) + spread(count)
            whose = np.repeat(of, count)
            step = self.xy[p + 1] - self.xy[p]
            size = length(step[:, 0], step[:, 1])
            px, py = x[whose] - self.xy[p, 0], y[whose] - self.xy[p, 1]
            t = np.clip((px * step[:, 0] + py * step[:, 1]) / np.where(size == 0, 1, size) ** 2, 0, 1)
            off = length(px - t * step[:, 0], py - t * step[:, 1])
            begin = np.cumsum(count) - count
            low = np.repeat(np.minimum.reduceat(off, begin), count)
            hit = np.flatnonzero(off == low)
            hit = hit[np.unique(whose[hit], return_index=True)[1]]  # of equals the first piece
            total = np.cumsum(size) - size
            out[whose[hit]] = total[hit] - np.repeat(total[begin], count)[hit] + t[hit] * size[hit]
        return out
