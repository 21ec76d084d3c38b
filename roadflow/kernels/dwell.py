"""Stationary runs of trajectories."""

from __future__ import annotations

import numpy as np

from roadflow.kernels.geodesy import A, F_, geodesic

#: Fixes of a run looked at first; each further look is at twice as many.
LOOK = 16
#: Planar distances under this many metres, away from the poles, are within this share of the geodesic; nearer the radius than that, the geodesic decides.
PLANAR_M, PLANAR_LAT, MARGIN = 20_000.0, 80.0, 0.005
_E2 = F_ * (2 - F_)


def _planar(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Metres on the plane that touches the ellipsoid between the points; NaN where that is no good."""
    phi = np.radians((lat1 + lat2) / 2)
    w = 1 - _E2 * np.sin(phi) ** 2
    dlon = (lon2 - lon1 + 180) % 360 - 180
    d = np.radians(np.hypot((lat2 - lat1) * A * (1 - _E2) / w**1.5, dlon * np.cos(phi) * A / np.sqrt(w)))
    return np.where((np.abs(lat1) < PLANAR_LAT) & (np.abs(lat2) < PLANAR_LAT) & (d < PLANAR_M), d, np.nan)


def _near(lon1, lat1, lon2, lat2, radius_m: float) -> np.ndarray:
    """Whether the points of each pair are within the radius; a missing coordinate is far."""
    d = _planar(lon1, lat1, lon2, lat2)
    near = d <= radius_m * (1 - MARGIN)
    for i in np.flatnonzero((np.isnan(d) | (np.abs(d - radius_m) <= radius_m * MARGIN)) & ~(np.abs(lat2 - lat1) * 110_000 > radius_m)):
        try:
            near[i] = float(geodesic(lon1[i], lat1[i], lon2[i], lat2[i])) <= radius_m
        except ValueError:  # nearly antipodal
            near[i] = False
    return near


def _run_end(lon: np.ndarray, lat: np.ndarray, i: int, radius_m: float) -> int:
    """The last fix in a row that is within the radius of fix i."""
    at, size = i + 1, LOOK
    while at < len(lon):
        to_lon, to_lat = lon[at : at + size], lat[at : at + size]
        far = ~_near(np.full(len(to_lon), lon[i]), np.full(len(to_lon), lat[i]), to_lon, to_lat, radius_m)
        if far.any():
            return at + int(far.argmax()) - 1
        at, size = at + size, 2 * size
    return len(lon) - 1


def dwell_mask(lon: np.ndarray, lat: np.ndarray, seconds: np.ndarray, radius_m: float, min_s: float, more: bool = False) -> tuple[np.ndarray, int]:
    """True for the fixes (in time order) of maximal runs near their first fix that last at least ``min_s``, and how many fixes are settled.

    A run that lasts holds the fix that comes ``min_s`` after its first: one look at that fix, for all at once, leaves few firsts to follow.
    more: the trajectory goes on, so runs up to its end are not settled.
    """
    n = len(lon)
    mask = np.zeros(n, bool)
    known = np.isfinite(lon) & np.isfinite(lat) & np.isfinite(seconds)
    after = np.maximum(np.searchsorted(seconds, seconds + min_s - 1e-6, "left"), np.arange(1, n + 1))
    some = np.flatnonzero(known & (after < n))
    d = _planar(lon[some], lat[some], lon[after[some]], lat[after[some]])
    firsts, done = some[~(d > radius_m * (1 + MARGIN))], 0
    for i in firsts.tolist():
        if i < done:
            continue
        j = _run_end(lon, lat, i, radius_m)
        if more and j == n - 1:
            return mask, i
        if j > i and seconds[j] - seconds[i] >= min_s:
            mask[i : j + 1] = True
            done = j + 1
    if not more:
        return mask, n
    # firsts whose look lies beyond what is here
    rest = np.flatnonzero(after >= n)
    return mask, max(done, int(rest[0]) if len(rest) else n)


def dwells(lon: np.ndarray, lat: np.ndarray, seconds: np.ndarray, start: np.ndarray, radius_m: float, min_s: float, more: bool = False) -> tuple[np.ndarray, int]:
    """``dwell_mask`` of trajectories that lie back to back. start: first fix of each, and the number of fixes."""
    masks, settled = [np.zeros(0, bool)], 0
    for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
        mask, n = dwell_mask(lon[a:b], lat[a:b], seconds[a:b], radius_m, min_s, more)
        masks.append(mask)
        settled = a + n
    return np.concatenate(masks), settled
