"""Shortest routes by distance, measured travel time, or any cost of edges, many at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadflow.functions.units import usable_speed
from roadflow.kernels import geodesy, structure
from roadflow.kernels.snap import Places
from roadflow.operators.aggregate import REGIMES
from roadflow.operators.analysis import weak_components
from roadflow.operators.network import Network

DEFAULT_SPEED_MPS = 11.176


def edge_travel_time(edges: DataFrame, *, period: str = "overall", default_speed_mps: float = DEFAULT_SPEED_MPS, use_maxspeed: bool = True) -> tuple[Column, Column]:
    """Seconds for an edge, and whether no speed was measured: the period's time, else the overall one, else its length at the posted limit or the default."""
    if period not in REGIMES:
        raise ValueError(f"period is one of {REGIMES}, not {period!r}")
    names = ["travel_time_s"] if period == "overall" else [f"travel_time_s_{period}", "travel_time_s"]
    known = [F.col(c) for c in names if c in edges.columns]
    measured = F.coalesce(*known, F.lit(None).cast("double"))
    posted = usable_speed(F.col("maxspeed_mps").cast("double")) if use_maxspeed and "maxspeed_mps" in edges.columns else F.lit(None).cast("double")
    return F.coalesce(measured, F.col("length_m") / F.coalesce(posted, F.lit(float(default_speed_mps)))), measured.isNull()


class Router:
    def __init__(self, network: Network, *, default_speed_mps: float = DEFAULT_SPEED_MPS, use_maxspeed: bool = True) -> None:
        if not (default_speed_mps > 0 and np.isfinite(default_speed_mps)):
            raise ValueError("default_speed_mps is a positive number")
        self.network, self.default_speed_mps, self.use_maxspeed = network, default_speed_mps, use_maxspeed
        self._nodes: tuple | None = None

    def _node_arrays(self) -> tuple:
        if self._nodes is None:
            shared = self.network.graph().value
            got = self.network.nodes.orderBy("node_id").toArrow()
            lon, lat = got.column("lon").to_numpy(), got.column("lat").to_numpy()
            x, y = geodesy.utm(lon, lat, shared["zone"], shared["north"])
            by_place = dict(zip(zip(lon.tolist(), lat.tolist()), shared["node_ids"].tolist()))
            self._nodes = self.network.edges.sparkSession.sparkContext.broadcast((shared["node_ids"], Places(x, y))), by_place
        return self._nodes

    def nearest_node(self, lon: float, lat: float) -> int:
        ids, places = self._node_arrays()[0].value
        shared = self.network.graph().value
        x, y = geodesy.utm([lon], [lat], shared["zone"], shared["north"])
        return int(ids[places.nearest(x, y)[0]])

    def _weights(self, mode: str, period: str, cost: Column | None) -> DataFrame:
        time, assumed = edge_travel_time(self.network.edges, period=period if mode == "time" else "overall", default_speed_mps=self.default_speed_mps, use_maxspeed=self.use_maxspeed)
        if mode == "cost" and cost is None:
            raise ValueError("mode='cost' needs cost=, a Column over the edges")
        weight = {"distance": F.col("length_m"), "time": time, "cost": cost}.get(mode)
        if weight is None:
            raise ValueError("mode is 'distance', 'time' or 'cost'")
        return self.network.edges.select("edge_id", "length_m", weight.cast("double").alias("w"), time.alias("t"), assumed.alias("assumed")).orderBy("edge_id")

    def route_many(self, trips: DataFrame, *, mode: str = "time", cost: Column | None = None, period: str = "overall", snap: bool = True) -> DataFrame:
        """trips with path (node ids), edge_ids, distance_m, travel_time_s, n_edges and n_edges_default; NULLs where there is no route.

        trips: trip_id and either o_lon, o_lat, d_lon, d_lat (snapped to the nearest nodes) or, without ``snap``, o_node and d_node.
        """
        spark = self.network.edges.sparkSession
        graph, nodes = self.network.graph(), self._node_arrays()[0]
        got = self._weights(mode, period, cost).toArrow()
        w, t, length, assumed = (got.column(c).to_numpy() for c in ("w", "t", "length_m", "assumed"))
        shared = spark.sparkContext.broadcast((w, t, length, assumed))
        ends = ["o_lon", "o_lat", "d_lon", "d_lat"] if snap else ["o_node", "d_node"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, (ids, places), (w, t, length, assumed) = graph.value, nodes.value, shared.value
            links = structure.cheapest(g["graph"].u, g["graph"].v, w, g["graph"].nodes)
            for b in batches:
                c = [np.asarray(b.column(i + 1)) for i in range(len(ends))]
                if snap:
                    at = []
                    for lon, lat in (c[:2], c[2:]):
                        x, y = geodesy.utm(lon, lat, g["zone"], g["north"])
                        at.append([k if k >= 0 else None for k in places.nearest(x, y).tolist()])
                else:
                    at = [[int(k) if k < len(ids) and ids[k] == v else None for k, v in zip(np.searchsorted(ids, x), x)] for x in c]
                rows = []
                for o, d in zip(*at):
                    found = structure.route(links, o, d) if o is not None and d is not None else None
                    if found is None:
                        rows.append((None,) * 6)
                        continue
                    edges = found[2]
                    rows.append((ids[found[1]].tolist(), edges, float(length[edges].sum()), float(t[edges].sum()), len(edges), int(assumed[edges].sum())))
                kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["trip_id", "path", "edge_ids", "distance_m", "travel_time_s", "n_edges", "n_edges_default"])

        kind = trips.schema["trip_id"].dataType.simpleString()
        return trips.select("trip_id", *ends).mapInArrow(run, f"trip_id {kind}, path array<long>, edge_ids array<long>, distance_m double, travel_time_s double, n_edges int, n_edges_default int")

    def _resolve(self, place, name: str, snap: bool) -> int:
        ids, by_place = self._node_arrays()[0].value[0], self._node_arrays()[1]
        if isinstance(place, (int, np.integer)):
            k = np.searchsorted(ids, int(place))
            if k < len(ids) and ids[k] == int(place):
                return int(place)
            raise ValueError(f"{name} {place!r} is no node of the network")
        try:
            lon, lat = (float(x) for x in place)
        except (TypeError, ValueError):
            raise ValueError(f"{name} {place!r} is neither a node nor (lon, lat)") from None
        if (lon, lat) in by_place:
            return by_place[lon, lat]
        if not snap:
            raise ValueError(f"{name} {place!r} is no node; pass snap=True for coordinates")
        return self.nearest_node(lon, lat)

    def route(self, origin, destination, *, mode: str = "time", cost: Column | None = None, snap: bool = True, period: str = "overall") -> dict:
        """One route, as a dict. Raises where there is none, and says why."""
        if self.network.edges.isEmpty():
            raise ValueError("the network has no edges")
        o, d = (self._resolve(p, n, snap) for p, n in ((origin, "origin"), (destination, "destination")))
        trips = self.network.edges.sparkSession.createDataFrame([(0, o, d)], "trip_id long, o_node long, d_node long")
        out = self.route_many(trips, mode=mode, cost=cost, period=period, snap=False).first().asDict()
        if out["path"] is None:
            label = {r["node_id"]: r["component"] for r in weak_components(self.network).filter(F.col("node_id").isin(o, d)).collect()}
            why = "one-way roads block it" if label[o] == label[d] else "the ends lie in unconnected parts of the network"
            raise ValueError(f"no {mode} route: {why}")
        out.pop("trip_id")
        return out

    def route_geometry_lonlat(self, routes: DataFrame) -> DataFrame:
        """trip_id and lonlat: the vertices of all edges of each route in a row; those at joints repeat."""
        each = routes.select("trip_id", F.posexplode("edge_ids").alias("pos", "edge_id")).join(self.network.edges.select("edge_id", "lonlat"), "edge_id")
        parts = each.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lonlat"))).alias("p"))
        return parts.select("trip_id", F.flatten("p.lonlat").alias("lonlat"))
