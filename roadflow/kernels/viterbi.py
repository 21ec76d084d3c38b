"""The likeliest edges of trajectories, by a hidden Markov model over arrays."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from roadflow.kernels.graph import Graph, length
from roadflow.kernels.snap import Pieces

#: Fixes whose steps are weighed together.
STEPS_AT_ONCE = 8192


@dataclass(frozen=True)
class Model:
    sigma: float = 6.0
    beta: float = 30.0
    reach: float = 50.0
    k: int = 8
    factor: float = 8.0

    def emission(self, off: np.ndarray) -> np.ndarray:
        return -0.5 * (off / self.sigma) ** 2 - math.log(math.sqrt(2 * math.pi) * self.sigma)

    def transition(self, gap: np.ndarray) -> np.ndarray:
        return -gap / self.beta - math.log(self.beta)


@dataclass
class Open:
    """What is carried on of a trajectory that goes on: its last decided fix's state and score."""

    edge: np.ndarray
    along: np.ndarray
    score: np.ndarray
    x: float
    y: float


def _steps(graph: Graph, m: Model, step: np.ndarray, edge: np.ndarray, along: np.ndarray, edge2: np.ndarray, along2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities (step, from, to) of going from states to states, -inf where unreachable, and those of a way as long as the cutoff."""
    cutoff = np.maximum(m.factor * step, 4 * m.reach)
    out = np.full((len(step), edge.shape[1], edge2.shape[1]), -np.inf)
    for k in range(0, len(step), STEPS_AT_ONCE):
        s = slice(k, k + STEPS_AT_ONCE)
        p, q = edge[s], edge2[s]
        both = (p >= 0)[:, :, None] & (q >= 0)[:, None, :]
        i, a, b = np.nonzero(both)
        e, f, far = p[i, a], q[i, b], cutoff[s][i]
        graph.along.need(graph.v[e], far)
        d = graph.along.distance(graph.v[e], graph.u[f], far)
        gap = np.abs(step[s][i] - (graph.length[e] - along[s][i, a] + d + along2[s][i, b]))
        gap[e == f] = 0.0
        some = np.isfinite(gap)
        out[k + i[some], a[some], b[some]] = m.transition(gap[some])
    return out, m.transition(cutoff)


def decode(graph: Graph, pieces: Pieces, x: np.ndarray, y: np.ndarray, start: np.ndarray, m: Model, carried: Open | None = None, more: bool = False) -> tuple[np.ndarray, np.ndarray, int, Open | None]:
    """Edge (-1: no candidate) and distance to it (NaN) of each fix of trajectories that lie back to back in time order.

    A state is an edge. A fix without candidates is passed over; a step runs from the last fix that had some. A state that none
    before reaches within the cutoff follows the best one at the cost of the whole cutoff. All trajectories go forward in step,
    the longest first, so a step is one operation on (trajectory, from, to).

    start: first fix of each trajectory, and the number of fixes. carried, more: for the one trajectory that comes in parts. Then only
    fixes whose state no later fix can change are decided; the last two results say how many and what to go on with.
    """
    n = len(x)
    edge, off, along = pieces.candidates(x, y, m.k)
    out, dist = np.full(n, -1, np.int64), np.full(n, np.nan)
    fix = np.flatnonzero(edge[:, 0] >= 0)
    if not len(fix):
        return out, dist, n, carried
    E, A, odds = edge[fix], along[fix], np.where(edge[fix] >= 0, m.emission(off[fix]), -np.inf)
    X, Y = x[fix], y[fix]
    head = np.searchsorted(fix, start[:-1])
    size = np.diff(np.append(head, len(fix)))
    if carried is not None:
        E, A, odds = (np.concatenate([np.pad(c, (0, m.k - len(c)), constant_values=fill)[None], v]) for c, v, fill in ((carried.edge, E, -1), (carried.along, A, 0), (carried.score, odds, -np.inf)))
        X, Y, size = np.append(carried.x, X), np.append(carried.y, Y), size + 1
    head = np.concatenate([[0], np.cumsum(size)])[:-1]
    head, size = head[size > 0], size[size > 0]
    order = np.argsort(-size, kind="stable")
    head, size = head[order], size[order]
    step = length(X[1:] - X[:-1], Y[1:] - Y[:-1])
    origin = np.zeros((len(E), E.shape[1]), np.int8)
    score = odds[head]
    last = np.empty((len(head), E.shape[1]))
    top = int(size[0])
    rows_at = max(1, STEPS_AT_ONCE // len(head))
    for t0 in range(1, top, rows_at):  # weigh some steps of all trajectories that are long enough, then go through them
        t1 = min(top, t0 + rows_at)
        alive = [int(np.searchsorted(-size, -t, "left")) for t in range(t0, t1)]  # trajectories longer than t
        to = np.concatenate([head[:a] + t for t, a in zip(range(t0, t1), alive)])
        going, lost = _steps(graph, m, step[to - 1], E[to - 1], A[to - 1], E[to], A[to])
        at = 0
        for t, a in zip(range(t0, t1), alive):
            if a < len(score):
                last[a : len(score)] = score[a:]
                score = score[:a]
            here = to[at : at + a]
            ways = score[:, :, None] + (going[at : at + a] + odds[here][:, None, :])
            came = ways.argmax(axis=1)
            best = np.take_along_axis(ways, came[:, None, :], 1)[:, 0, :]
            none = np.isneginf(best) & (E[here] >= 0)
            if none.any():
                r, c = np.nonzero(none)
                first = score.argmax(axis=1)
                came[r, c] = first[r]
                best[r, c] = score[r, first[r]] + lost[at : at + a][r] + odds[here[r], c]
            origin[here], score = came, best
            at += a
    last[: len(score)] = score
    state = last.argmax(axis=1)
    decided, kept = len(fix), None
    chosen = np.full(len(E), -1, np.int64)
    if more:  # one trajectory: back to where all states that are still open meet
        open_ = np.flatnonzero(np.isfinite(last[0]))
        t = top - 1
        while t > 0 and len(open_) > 1:
            open_ = np.unique(origin[head[0] + t][open_])
            t -= 1
        meet = head[0] + t
        if len(open_) == 1:
            top, state = t + 1, open_
            # scores up to the meeting point are the same for all; what is carried starts from nought
            kept = Open(E[meet, open_], A[meet, open_], np.zeros(1), float(X[meet]), float(Y[meet]))
            size = np.array([top])
        else:  # nothing is decided yet
            return out, dist, 0, carried
    for t in range(top - 1, -1, -1):
        a = int(np.searchsorted(-size, -t, "left"))
        here = head[:a] + t
        chosen[here] = state[:a]
        state[:a] = origin[here, state[:a]]
    lead = 0 if carried is None else 1
    mine = chosen[lead:]
    some = np.flatnonzero(mine >= 0)
    out[fix[some]], dist[fix[some]] = E[lead + some, mine[some]], off[fix[some], mine[some]]
    if more:
        decided = top - lead
        return out, dist, int(fix[decided - 1]) + 1 if decided else 0, kept
    return out, dist, n, None
