"""Structure of a network: betweenness, densities, connectivity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.functions.geo import geodesic_distance
from roadflow.functions.units import finite
from roadflow.kernels import structure
from roadflow.operators.network import Network
from roadflow.session import written


def require_weight(edges: DataFrame, weight: str) -> None:
    """Every edge must have the weight: one aggregate, and a clear error."""
    if weight not in edges.columns:
        raise ValueError(f"edges have no column {weight!r}: assign speeds first, weigh by length_m, or pass None")
    w = F.col(weight).cast("double")
    missing = edges.filter(w.isNull() | F.isnan(w)).count()
    if missing:
        raise ValueError(f"{missing} edges have no {weight!r}: a speed of 0 has no travel time, and an unobserved edge needs a default speed")


def edge_betweenness_centrality(network: Network, *, weight: str | None, normalized: bool = True, k: int | None = None, seed: int = 0) -> DataFrame:
    """edge_id and betweenness: the share of shortest paths between all pairs of nodes that use the edge.

    Sources are dealt out; each task follows its own over the broadcast graph and adds up by edge, so only sums are shuffled. k: sources to
    sample, chosen by a hash of node and seed; sums are scaled up to all sources.
    """
    if k is not None and k < 1:
        raise ValueError("k is at least 1")
    if weight is not None:
        require_weight(network.edges, weight)
    spark = network.edges.sparkSession
    graph = network.graph()
    w = network.edges.select("edge_id", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).orderBy("edge_id").toArrow().column("w").to_numpy()
    weights = spark.sparkContext.broadcast(w)
    n = graph.value["graph"].nodes
    sources = spark.range(n).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(min(k, n)) if k else spark.range(n)
    scale = (n / min(k, n) if k else 1.0) / (n * (n - 1) if normalized and n > 1 else 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value["graph"]
        for b in batches:
            total = structure.betweenness(g.u, g.v, weights.value, g.nodes, np.asarray(b.column(0)))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["edge_id", "b"])

    parts = sources.repartition(spark.sparkContext.defaultParallelism, "id").mapInArrow(run, "edge_id long, b double").groupBy("edge_id").agg(F.sum("b").alias("b"))
    return network.edges.select("edge_id").join(parts, "edge_id", "left").select("edge_id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def road_degrees(network: Network) -> DataFrame:
    """node_id and how many roads (not directed edges) meet there."""
    ends = network.edges.select("road_id", F.explode(F.array("u", "v")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count_distinct("road_id").alias("degree"))


def _vertices(network: Network) -> DataFrame:
    return network.edges.select(F.explode("xy").alias("p")).select("p.x", "p.y")


def area_km2(network: Network, method: str = "convex_hull") -> float | None:
    """Of the hull of all vertices, or of their bounding box; None if that is no area. Tasks send the corners of their own hulls."""
    if method == "bbox":
        b = _vertices(network).agg(F.count("*").alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) / 1e6).alias("a")).first()
        return b["a"] if b["n"] >= 3 and b["a"] else None
    if method != "convex_hull":
        raise ValueError("area_method is 'convex_hull', 'bbox' or None")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corners = np.zeros((0, 2))
        for b in batches:
            corners = structure.hull(np.concatenate([corners, b.to_numpy(float)]))
        yield pd.DataFrame(corners, columns=["x", "y"])

    got = _vertices(network).mapInPandas(run, "x double, y double").toPandas().to_numpy()  # corners of hulls only
    size = structure.area(structure.hull(got)) / 1e6
    return size or None


def network_stats(network: Network, *, area_km2_: float | None = None, area_method: str | None = "convex_hull") -> dict:
    """Counts, degrees, circuity and densities. A given area outranks a detected one."""
    e = network.edges.join(network.nodes.select(F.col("node_id").alias("u"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1")), "u").join(network.nodes.select(F.col("node_id").alias("v"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), "v")
    lengths = e.agg(F.count("*").alias("n_edges"), F.sum("length_m").alias("length"), F.sum(geodesic_distance("lon1", "lat1", "lon2", "lat2")).alias("direct"))
    roads = network.edges.groupBy("road_id").agg(F.min_by("length_m", "edge_id").alias("length")).agg(F.count("*").alias("n_physical_roads"), F.sum("length").alias("road_m"))
    row = lengths.crossJoin(roads).first()  # one row each
    counts = {r["degree"]: r["n"] for r in road_degrees(network).groupBy("degree").agg(F.count("*").alias("n")).collect()}
    nodes, meet = sum(counts.values()), sum(d * n for d, n in counts.items())
    source = "supplied" if area_km2_ is not None else area_method
    size = area_km2_ if area_km2_ is not None else area_km2(network, area_method) if area_method else None
    crossings = sum(n for d, n in counts.items() if d >= 3)
    return {
        "n_nodes": nodes, "n_edges": row["n_edges"], "n_physical_roads": row["n_physical_roads"], "n_intersections": crossings, "n_dead_ends": counts.get(1, 0),
        "streets_per_node_avg": meet / nodes if nodes else None, "streets_per_node_counts": counts, "circuity_avg": row["length"] / row["direct"] if row["direct"] else None,
        "area_km2": size, "area_method": source if size is not None else None,
        "intersection_density_km2": crossings / size if size else None, "edge_density_km2": row["road_m"] / size if size else None,
    }


def weak_components(network: Network) -> DataFrame:
    """node_id and component: the smallest node connected with it, whichever way edges run. Labels and their labels spread until they rest."""
    links = network.edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = written(network.nodes.select("node_id", F.col("node_id").alias("component")), "labels")
    while True:
        near = both.join(label, both["b"] == label["node_id"]).groupBy("a").agg(F.min("component").alias("low"))
        new = label.join(near, label["node_id"] == near["a"], "left").select("node_id", "component", F.least("component", F.coalesce("low", "component")).alias("next"))
        of = label.select(F.col("node_id").alias("__n"), F.col("component").alias("__c"))
        new = written(new.join(of, new["next"] == of["__n"]).select("node_id", F.least("next", "__c").alias("component"), (F.least("next", "__c") < F.col("component")).alias("moved")), "labels")
        label = new.select("node_id", "component")
        if new.filter("moved").isEmpty():
            return label


def strong_components(network: Network) -> DataFrame:
    """node_id and component: the smallest node that it reaches and that reaches it. On the driver, under the network's own size limit."""
    shared = network.graph().value
    g = shared["graph"]
    label = structure.strong_components(g.u, g.v, g.nodes)
    return network.edges.sparkSession.createDataFrame(pd.DataFrame({"node_id": shared["node_ids"], "component": shared["node_ids"][label]}))


@dataclass(frozen=True)
class Connectivity:
    """nodes: node_id, component, in_largest. edges: edge_id, in_largest. sizes: how many strong components have each size."""

    nodes: DataFrame
    edges: DataFrame
    sizes: DataFrame
    summary: dict


def connectivity_report(network: Network) -> Connectivity:
    strong = written(strong_components(network), "strong")
    sizes = strong.groupBy("component").agg(F.count("*").alias("n"))
    biggest = sizes.orderBy(F.desc("n"), "component").limit(1).select(F.col("component").alias("__top"))
    nodes = strong.crossJoin(F.broadcast(biggest)).select("node_id", "component", (F.col("component") == F.col("__top")).alias("in_largest"))  # one row beside each
    inside = nodes.select("node_id", "in_largest")
    edges = network.edges.select("edge_id", "u", "v")
    for end in "uv":
        edges = edges.join(inside.withColumnsRenamed({"node_id": end, "in_largest": f"__{end}"}), end)
    edges = edges.select("edge_id", (F.col("__u") & F.col("__v")).alias("in_largest"))
    by_size = written(sizes.groupBy(F.col("n").alias("size")).agg(F.count("*").alias("components")), "sizes")
    spread = {r["size"]: r["components"] for r in by_size.orderBy(F.desc("size")).collect()}  # all sizes differ, so they are fewer than the root of twice the nodes
    total = sizes.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    weak = weak_components(network).select("component").distinct().count()
    summary = {
        "n_nodes": total["n"] or 0, "n_edges": network.edges.count(), "is_strongly_connected": total["k"] <= 1, "n_strongly_connected_components": total["k"], "strongly_connected_component_sizes": spread,
        "largest_component_fraction_nodes": next(iter(spread)) / total["n"] if spread else None, "is_weakly_connected": weak <= 1, "n_weakly_connected_components": weak,
    }
    return Connectivity(nodes, edges, by_size, summary)


def with_betweenness(network: Network, betweenness: DataFrame, name: str) -> Network:
    """The network with the centrality as an edge column; a column that the engine owns is refused."""
    if name in ("edge_id", "u", "v", "length_m", "xy", "lonlat", "reverse_id", "road_id"):
        raise ValueError(f"{name!r} is a column of the network itself")
    return network.with_edges(network.edges.drop(name).join(betweenness.select("edge_id", finite(F.col("betweenness")).alias(name)), "edge_id", "left"))
