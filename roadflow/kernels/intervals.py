"""Speeds of trajectories from the way along roads between their fixes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from roadflow.kernels.graph import Graph, length

#: Hops that are measured together.
HOPS_AT_ONCE = 32_768


@dataclass(frozen=True)
class Rules:
    min_dt_s: float = 0.5
    max_dt_s: float = 120.0
    max_snap_dist_m: float = 60.0
    max_speed_mps: float = 60.0
    min_snr: float = 3.0
    max_route_dist_factor: float = 6.0
    route_cutoff_floor_m: float = 300.0
    min_baseline_m: float | None = None


def hops(graph: Graph, edge: np.ndarray, arc: np.ndarray, edge2: np.ndarray, arc2: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of places on edges, the metres between them whichever way roads run, infinite beyond the cutoff, and how: the way's two end nodes (-1: along one road).

    A place's two ways off its road are the road's ends; the table of node distances, looked up once for the four pairs of ends, leaves
    a matrix of 2 x 2 sums to take the least of.
    """
    ends, ends2 = (np.stack([graph.u[e], graph.v[e]], axis=1) for e in (edge, edge2))
    off, off2 = (np.stack([a, graph.length[e] - a], axis=1) for a, e in ((arc, edge), (arc2, edge2)))
    # the first of equal sums stays, so both directions of a road list its ends in the same order
    turn, turn2 = ends[:, 0] > ends[:, 1], ends2[:, 0] > ends2[:, 1]
    ends[turn], off[turn], ends2[turn2], off2[turn2] = ends[turn, ::-1], off[turn, ::-1], ends2[turn2, ::-1], off2[turn2, ::-1]
    limit = np.broadcast_to(cutoff[:, None, None], (len(edge), 2, 2))
    graph.either.need(ends.ravel(), np.repeat(cutoff, 2))
    between = graph.either.distance(np.repeat(ends[:, :, None], 2, 2), np.repeat(ends2[:, None, :], 2, 1), limit)
    total = (off[:, :, None] + between + off2[:, None, :]).reshape(-1, 4)
    best = total.argmin(axis=1)
    rows = np.arange(len(edge))
    metres, leave, enter = total[rows, best], ends[rows, best // 2], ends2[rows, best % 2]
    direct = np.where(edge == edge2, np.abs(arc - arc2), np.where(graph.reverse[edge] == edge2, np.abs(graph.length[edge] - arc - arc2), np.inf))
    straight = direct < metres
    return np.where(straight, direct, metres), np.where(straight, -1, leave), np.where(straight, -1, enter)


def _touched(graph: Graph, edge: np.ndarray, edge2: np.ndarray, leave: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hop and edge, sorted: all edges, in both directions, of the roads that each hop is on."""
    every = np.arange(len(edge))
    on = np.flatnonzero(leave >= 0)
    way, step = graph.either.steps(leave[on], enter[on])
    hop, e = np.concatenate([every, every, on[way]]), np.concatenate([edge, edge2, step])
    hop, e = np.concatenate([hop, hop]), np.concatenate([e, graph.reverse[e]])
    key = np.unique(hop[e >= 0] * len(graph.u) + e[e >= 0])
    return key // max(1, len(graph.u)), key % max(1, len(graph.u))


def _joined(metres: np.ndarray, start: np.ndarray, baseline: float | None, more: bool) -> tuple[list[int], list[int], list[float], list[bool], int]:
    """From, to, metres and whether the baseline was reached, of each interval; and the fix that an unfinished last one starts from.

    metres: to the next fix, infinite where there is no way. An interval grows hop by hop up to the baseline. One that meets an
    endless hop is given up, and the next starts at the last fix it had reached.
    """
    if baseline is None:
        at = np.flatnonzero(np.isfinite(metres))
        return at.tolist(), (at + 1).tolist(), metres[at].tolist(), [True] * len(at), len(metres) - more
    first, last, total, whole = [], [], [], []
    way, bounds = metres.tolist(), start.tolist()
    unfinished = len(way)
    for low, high in zip(bounds, bounds[1:]):
        begin, sum_, i = low, 0.0, low
        while i < high - 1:
            d = way[i]
            i += 1
            if d == np.inf:
                begin, sum_ = i, 0.0
                continue
            sum_ += d
            if sum_ >= baseline:
                first.append(begin)
                last.append(i)
                total.append(sum_)
                whole.append(True)
                begin, sum_ = i, 0.0
        if begin < high - 1:
            if more:
                unfinished = begin
            else:
                first.append(begin)
                last.append(high - 1)
                total.append(sum_)
                whole.append(False)
        elif more:
            unfinished = high - 1
    return first, last, total, whole, unfinished


def derive(graph: Graph, start: np.ndarray, seconds: np.ndarray, x: np.ndarray, y: np.ndarray, edge: np.ndarray, snap: np.ndarray | None, sigma: np.ndarray, r: Rules, more: bool = False) -> tuple[dict[str, np.ndarray], int]:
    """The intervals of trajectories that lie back to back in time order, as arrays: from and to (places), dt_s, distance_m, speed, snap,
    sigma of speed, quality, and the edges touched as one ragged array (``edges``, ``n_edges``).

    start: first fix of each trajectory, and the number of fixes. snap: None where the input has no such column; sigma: of each fix.
    more: the only trajectory goes on; then the second result is the fix to go on from.
    """
    n = len(x)
    arc = graph.arcs(edge, x, y)
    inner = np.ones(max(0, n - 1), bool)
    inner[start[1:-1] - 1] = False
    metres, leave, enter = np.full(n, np.inf), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    steps = np.flatnonzero(inner & (edge[:-1] >= 0) & (edge[1:] >= 0)) if n > 1 else np.zeros(0, np.int64)
    touched = []
    for k in range(0, len(steps), HOPS_AT_ONCE):
        i = steps[k : k + HOPS_AT_ONCE]
        cutoff = np.maximum(r.max_route_dist_factor * length(x[i + 1] - x[i], y[i + 1] - y[i]), r.route_cutoff_floor_m)
        metres[i], leave[i], enter[i] = hops(graph, edge[i], arc[i], edge[i + 1], arc[i + 1], cutoff)
        i = i[np.isfinite(metres[i])]
        hop, e = _touched(graph, edge[i], edge[i + 1], leave[i], enter[i])  # while the table still has these ways
        touched.append((i[hop], e))
    metres[start[1:] - 1] = np.inf
    a, b, total, whole, unfinished = _joined(metres, start, r.min_baseline_m, more)
    a, b, total, whole = np.array(a, np.int64), np.array(b, np.int64), np.array(total, float), np.array(whole, bool)
    dt = seconds[b] - seconds[a]
    timed = dt > 0
    a, b, total, whole, dt = a[timed], b[timed], total[timed], whole[timed], dt[timed]
    noise, speed = np.hypot(sigma[a], sigma[b]), total / dt
    if snap is None:
        close, farthest = np.ones(len(a), bool), np.full(len(a), np.nan)
    else:
        pair = np.stack([snap[a], snap[b]])
        pair[~np.isfinite(pair)] = np.nan
        farthest, close = np.fmax(*pair), np.isfinite(pair).all(axis=0) & (np.fmax(*pair) <= r.max_snap_dist_m)
    good = (total >= r.min_snr * noise) & (r.min_dt_s <= dt) & (dt <= r.max_dt_s) & (speed >= 0) & (speed <= r.max_speed_mps) & close & whole
    # each interval's edges, in the order of hops, then of ids, each once
    hop, e = (np.concatenate([t[j] for t in touched]) if touched else np.zeros(0, np.int64) for j in (0, 1))
    of = np.searchsorted(a, hop, "right") - 1
    mine = (of >= 0) & (hop < b[of]) if len(a) else np.zeros(len(hop), bool)
    of, e = of[mine], e[mine]
    first = np.sort(np.unique(of * max(1, len(graph.u)) + e, return_index=True)[1])
    of, e = of[first], e[first]
    return {"from": a, "to": b, "dt_s": dt, "distance_m": total, "speed_mps": speed, "snap": farthest, "sigma": noise / dt, "quality": good, "edges": e, "n_edges": np.bincount(of, minlength=len(a))}, unfinished
