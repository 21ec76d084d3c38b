"""Nearest edges by a grid over short pieces of edges."""

from __future__ import annotations

import numpy as np

from roadflow.kernels.graph import length

#: Side of the small cells whose nearest pieces are looked up once, and how many cells a worker keeps.
SPOT_M, SPOTS_KEPT = 12.5, 1 << 17
#: Fixes that are looked at together.
FIXES_AT_ONCE = 16_384


class Pieces:
    """Pieces of edges of at most ``piece`` metres, binned by their middles.

    Two levels: a coarse grid finds, for the centre of a small cell, every piece that may be among the nearest of some fix in the
    cell; that list is kept, and the cell's fixes choose from it side by side in one matrix.
    """

    def __init__(self, edge: np.ndarray, ends: np.ndarray, arc: np.ndarray, reach: float, piece: float) -> None:
        self.edge, self.ends, self.arc, self.reach, self.piece = edge, ends, arc, reach, piece
        #: A fix within reach of a piece has the piece's middle within this.
        self.far = reach + piece / 2
        self.wide = self.far + SPOT_M
        mid = (ends[:, :2] + ends[:, 2:]) / 2
        self.origin = np.floor(mid.min(axis=0) / self.wide) - 1 if len(mid) else np.zeros(2)
        place = np.floor(mid / self.wide) - self.origin
        self.across = int(place[:, 1].max()) + 3 if len(mid) else 1
        key = (place[:, 0] * self.across + place[:, 1]).astype(np.int64)
        # in a cell by edge, then piece: the order that ties are settled in
        self.order = np.lexsort((np.arange(len(key)), edge, key))
        self.key, self.mid = key[self.order], mid
        self.rank = np.empty(len(edge), np.int64)
        self.rank[np.lexsort((np.arange(len(edge)), edge))] = np.arange(len(edge))
        self._spots: dict[int, dict] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_spots"} | {"_spots": {}}

    def _around(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and piece: the pieces in the nine coarse cells around each place."""
        cx, cy = np.floor(x / self.wide) - self.origin[0], np.floor(y / self.wide) - self.origin[1]
        inside = (cy >= 0) & (cy < self.across - 1)
        base = np.where(inside, cx * self.across + cy, -(10**15)).astype(np.int64)
        places, pieces = [], []
        for dx in (-1, 0, 1):
            low = np.searchsorted(self.key, base + dx * self.across - 1, "left")
            n = np.searchsorted(self.key, base + dx * self.across + 1, "right") - low  # three cells in a row of the grid
            places.append(np.repeat(np.arange(len(x)), n))
            pieces.append(self.order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.concatenate(places), np.concatenate(pieces)

    def _look(self, sx: np.ndarray, sy: np.ndarray, k: int) -> list[np.ndarray]:
        """For each small cell the pieces that may be among the k nearest middles, within ``far``, of a fix in it."""
        x, y, half = (sx + 0.5) * SPOT_M, (sy + 0.5) * SPOT_M, SPOT_M * 0.5**0.5
        place, piece = self._around(x, y)
        far = np.hypot(x[place] - self.mid[piece, 0], y[place] - self.mid[piece, 1])
        near = far <= self.far + half
        place, piece, far = place[near], piece[near], far[near]
        order = np.lexsort((far, place))
        place, piece, far = place[order], piece[order], far[order]
        n = np.bincount(place, minlength=len(x))
        start = np.cumsum(n) - n
        # a fix's k-th nearest middle is at most half a cell farther than the centre's; the margin is for rounded ties
        limit = np.full(len(x), np.inf)
        many = n > k
        limit[many] = far[start[many] + k - 1] + 2 * half + 1e-5
        keep = far <= limit[place]
        place, piece = place[keep], piece[keep]
        order = np.lexsort((self.rank[piece], place))
        return np.split(piece[order], np.cumsum(np.bincount(place, minlength=len(x)))[:-1])

    def short_lists(self, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        """(fix, slot) pieces, -1 where a list is shorter: for each fix all that may be among its k nearest, in the order of ties."""
        spots = self._spots.setdefault(k, {})
        sx, sy = np.floor(x / SPOT_M), np.floor(y / SPOT_M)
        cells, cell = np.unique(sx * float(1 << 26) + sy, return_inverse=True)
        new = [i for i, c in enumerate(cells.tolist()) if c not in spots]
        if len(spots) + len(new) > SPOTS_KEPT:
            spots.clear()
            new = list(range(len(cells)))
        if new:
            first = np.zeros(len(cells), np.int64)
            first[cell[::-1]] = np.arange(len(x))[::-1]
            at = first[new]
            for part in range(0, len(at), FIXES_AT_ONCE):
                some = at[part : part + FIXES_AT_ONCE]
                spots.update(zip(cells[new[part : part + FIXES_AT_ONCE]].tolist(), self._look(sx[some], sy[some], k)))
        lists = [spots[c] for c in cells.tolist()]
        size = np.array([len(p) for p in lists])
        table = np.full((len(cells), max(1, int(size.max(initial=0)))), -1, np.int64)
        if size.sum():
            table[np.repeat(np.arange(len(cells)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.concatenate(lists)
        return table[cell]

    def _nearest(self, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Piece (-1: none), distance (inf) and metres along the edge of each fix's ``k`` pieces with the nearest middles, in the order of middles."""
        piece = self.short_lists(x, y, k)
        far = length(x[:, None] - self.mid[piece, 0], y[:, None] - self.mid[piece, 1])
        far[(piece < 0) | (far > self.far)] = np.inf
        if piece.shape[1] > k:
            chosen = np.argsort(np.round(far, 6), axis=1, kind="stable")[:, :k]
            piece, far = np.take_along_axis(piece, chosen, 1), np.take_along_axis(far, chosen, 1)
        x0, y0, x1, y1 = (self.ends[piece, c] for c in range(4))
        dx, dy = x1 - x0, y1 - y0
        size2 = dx * dx + dy * dy
        t = np.clip(((x[:, None] - x0) * dx + (y[:, None] - y0) * dy) / np.where(size2 == 0, 1e-12, size2), 0, 1)
        off = np.hypot(x[:, None] - x0 - t * dx, y[:, None] - y0 - t * dy)
        none = np.isinf(far) | (off > self.reach)
        off[none] = np.inf
        return np.where(none, -1, piece), off, self.arc[piece] + t * np.sqrt(size2)

    def candidates(self, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fix, slot) edges, distances and metres along the edge: each fix's edges, nearest first, each edge once; then -1, inf and 0."""
        edge, dist, along = np.full((len(x), k), -1, np.int64), np.full((len(x), k), np.inf), np.zeros((len(x), k))
        every = np.flatnonzero(np.isfinite(x) & np.isfinite(y)) if len(self.edge) else np.zeros(0, np.int64)
        for part in range(0, len(every), FIXES_AT_ONCE):
            of = every[part : part + FIXES_AT_ONCE]
            piece, off, arc = self._nearest(x[of], y[of], k)
            e = np.where(piece < 0, -1, self.edge[piece])
            # by distance, ties by edge; what comes again goes to the end
            order = np.argsort(e, axis=1, kind="stable")
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(np.round(off, 6), order, 1), axis=1, kind="stable"), 1)
            e, off, arc = (np.take_along_axis(v, order, 1) for v in (e, off, arc))
            again = e < 0
            for j in range(1, e.shape[1]):
                again[:, j] |= (e[:, :j] == e[:, j : j + 1]).any(axis=1)
            order = np.argsort(again, axis=1, kind="stable")
            again = np.take_along_axis(again, order, 1)
            n = e.shape[1]
            edge[of, :n] = np.where(again, -1, np.take_along_axis(e, order, 1))
            dist[of, :n] = np.where(again, np.inf, np.take_along_axis(off, order, 1))
            along[of, :n] = np.where(again, 0.0, np.take_along_axis(arc, order, 1))
        return edge, dist, along

    def nearest(self, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest edge of each fix (-1 beyond reach) and its distance (NaN)."""
        edge, dist = np.full(len(x), -1, np.int64), np.full(len(x), np.nan)
        every = np.flatnonzero(np.isfinite(x) & np.isfinite(y)) if len(self.edge) else np.zeros(0, np.int64)
        for part in range(0, len(every), FIXES_AT_ONCE):
            of = every[part : part + FIXES_AT_ONCE]
            piece, off, _ = self._nearest(x[of], y[of], k)
            r = np.round(off, 6)
            e = np.where((r == r.min(axis=1, keepdims=True)) & (piece >= 0), self.edge[piece], np.iinfo(np.int64).max)
            best = e.argmin(axis=1)
            rows = np.arange(len(of))
            found = piece[rows, best] >= 0
            edge[of[found]], dist[of[found]] = e[rows, best][found], off[rows, best][found]
        return edge, dist


class Places:
    """The nearest of many places, however far, by a grid of cells that hold about two places each and are looked at ring by ring."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y = x, y
        n = max(1, len(x))
        span = max(float(np.ptp(x)), float(np.ptp(y)), 1.0) if len(x) else 1.0
        self.cell = span / max(1.0, (n / 2) ** 0.5)
        self.low = np.array([x.min(initial=0), y.min(initial=0)]) if not len(x) else np.array([x.min(), y.min()])
        cx, cy = self._cell(x, y)
        self.wide, self.high = int(cx.max(initial=0)) + 1, int(cy.max(initial=0)) + 1
        key = cx * self.high + cy
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]

    def _cell(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.floor((x - self.low[0]) / self.cell).astype(np.int64), np.floor((y - self.low[1]) / self.cell).astype(np.int64)

    def nearest(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The index of the nearest place (of equals the first); -1 for a place that is not known."""
        best, near = np.full(len(x), -1, np.int64), np.full(len(x), np.inf)
        todo = np.flatnonzero(np.isfinite(x) & np.isfinite(y)) if len(self.x) else np.zeros(0, np.int64)
        # from outside the grid the search starts at its edge
        cx, cy = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        cx[todo], cy[todo] = self._cell(np.clip(x[todo], self.low[0], self.low[0] + self.wide * self.cell * (1 - 1e-12)), np.clip(y[todo], self.low[1], self.low[1] + self.high * self.cell * (1 - 1e-12)))
        ring = 0
        while len(todo):
            for dx in range(-ring, ring + 1):
                for dy0, dy1 in ((-ring, ring),) if abs(dx) == ring else ((-ring, -ring), (ring, ring)):
                    col = cx[todo] + dx
                    lo, hi = np.maximum(cy[todo] + dy0, 0), np.minimum(cy[todo] + dy1, self.high - 1)
                    inside = (col >= 0) & (col < self.wide) & (lo <= hi)
                    of, col, lo, hi = todo[inside], col[inside], lo[inside], hi[inside]
                    a = np.searchsorted(self.key, col * self.high + lo, "left")
                    n = np.searchsorted(self.key, col * self.high + hi, "right") - a
                    who = np.repeat(of, n)
                    place = self.order[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    d = (x[who] - self.x[place]) ** 2 + (y[who] - self.y[place]) ** 2
                    rank = np.lexsort((place, d, who))
                    who, place, d = who[rank], place[rank], d[rank]
                    first = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
                    who, place, d = who[first], place[first], d[first]
                    closer = (d < near[who]) | ((d == near[who]) & (place < best[who]))
                    best[who[closer]], near[who[closer]] = place[closer], d[closer]
            # a place in a ring farther out is at least this far from the clipped point, and so from the point itself
            px, py = np.clip(x[todo], self.low[0], self.low[0] + self.wide * self.cell), np.clip(y[todo], self.low[1], self.low[1] + self.high * self.cell)
            edge = np.minimum.reduce([px - self.low[0] - (cx[todo] - ring) * self.cell, (cx[todo] + ring + 1) * self.cell + self.low[0] - px, py - self.low[1] - (cy[todo] - ring) * self.cell, (cy[todo] + ring + 1) * self.cell + self.low[1] - py])
            # from the point itself: the way to the grid comes on top, squared
            out = (x[todo] - px) ** 2 + (y[todo] - py) ** 2
            todo = todo[near[todo] > np.maximum(edge, 0) ** 2 + out] if ring <= max(self.wide, self.high) else todo[:0]
            ring += 1
        return best
