"""Maps of speeds: GeoJSON, and the table behind a picture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.functions.units import SpeedUnit, from_mps
from roadflow.operators.aggregate import REGIMES
from roadflow.operators.network import Network

KEEP_TAGS = ("name", "highway", "maxspeed", "oneway", "ref")
COMPUTED = ("edge_id", "edge_ids", "has_speed", "speed", "speed_unit", "period", "length_m", "travel_time_s")


def speed_features(network: Network, *, directional: bool = False, period: str = "overall", speed_unit="mph") -> DataFrame:
    """One row for each road (or directed edge): its edges, speed of the period, length, travel time at that speed, and vertices.

    A road's speed is the mean of its observed directions; shape and tags are those of its smaller edge id. 0 m/s is a speed without travel time.
    """
    if period not in REGIMES:
        raise ValueError(f"period is one of {REGIMES}, not {period!r}")
    unit, name = SpeedUnit.parse(speed_unit), "obs_speed_mps" if period == "overall" else f"obs_speed_mps_{period}"
    speed = F.col(name) if name in network.edges.columns else F.lit(None).cast("double")
    e = network.edges.select("edge_id", "road_id", "length_m", "lonlat", "props", speed.alias("mps"))
    key = "edge_id" if directional else "road_id"
    first = lambda c: F.min_by(c, "edge_id").alias(c)
    e = e.groupBy(F.col(key).alias("feature_id")).agg(F.sort_array(F.collect_list("edge_id")).alias("edge_ids"), F.avg("mps").alias("mps"), first("length_m"), first("lonlat"), first("props"))
    return e.select(
        F.col("edge_ids")[0].alias("edge_id"), "edge_ids", F.col("mps").isNotNull().alias("has_speed"), from_mps(F.col("mps"), unit).alias("speed"), F.lit(unit.value).alias("speed_unit"), F.lit(period).alias("period"),
        "length_m", F.when(F.col("mps") > 0, F.col("length_m") / F.col("mps")).alias("travel_time_s"), "lonlat", "props",
    )


def to_geojson(network: Network, path: str | None = None, *, directional: bool = False, period: str = "overall", speed_unit="mph", keep_tags: tuple[str, ...] | None = KEEP_TAGS) -> DataFrame:
    """Features as JSON text, one a row, written to a folder of part files if a path is given."""
    f = speed_features(network, directional=directional, period=period, speed_unit=speed_unit)
    tags = [F.try_element_at("props", F.lit(t)).alias(f"{t}_src" if t in COMPUTED else t) for t in keep_tags or ()]
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("lonlat", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    out = f.select("edge_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*COMPUTED, *tags).alias("properties"))).alias("feature"))
    if path:
        out.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)
    return out


def save_geojson(network: Network, path: str, **options) -> None:
    """One GeoJSON file on the driver's disk, for tools that read no part files; features are streamed, not gathered."""
    n = seen = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write('{"type": "FeatureCollection", "features": [')
        for row in to_geojson(network, **options).toLocalIterator():
            out.write(("," if n else "") + row["feature"])
            n += 1
            seen += '"has_speed":true' in row["feature"]
        unit, period = SpeedUnit.parse(options.get("speed_unit", "mph")).value, options.get("period", "overall")
        out.write(f'], "properties": {{"n_edges_observed": {seen}, "n_edges_total": {n}, "speed_unit": "{unit}", "period": "{period}"}}}}')


def plot_table(network: Network, *, period: str = "overall", speed_unit="mph", vmin: float | None = None, vmax: float | None = None) -> tuple[DataFrame, float | None, float | None]:
    """The features of a map, and the limits of its colours: the 5th and 95th percentile of observed speeds unless given."""
    f = speed_features(network, period=period, speed_unit=speed_unit)
    q = f.agg(F.percentile("speed", F.array(F.lit(0.05), F.lit(0.95))).alias("q")).first()["q"] or [None, None]
    return f, q[0] if vmin is None else vmin, q[1] if vmax is None else vmax


def plot_speed_map(network: Network, path: str, *, period: str = "overall", speed_unit="mph", cmap: str = "RdYlGn", vmin=None, vmax=None, no_data_color: str = "#cccccc", linewidth: float = 2.0, figsize=(10, 10), dpi: int = 150) -> str:
    """A picture of the map, if matplotlib is there to draw it."""
    try:
        import matplotlib.pyplot as plt
        from matplotlib.collections import LineCollection
    except ImportError as e:
        raise ImportError("drawing needs matplotlib; plot_table gives what it would draw") from e
    table, low, high = plot_table(network, period=period, speed_unit=speed_unit, vmin=vmin, vmax=vmax)
    rows = table.select("lonlat", "speed").collect()
    fig, ax = plt.subplots(figsize=figsize)
    line = lambda rs: [[(p["lon"], p["lat"]) for p in r["lonlat"]] for r in rs]
    ax.add_collection(LineCollection(line([r for r in rows if r["speed"] is None]), colors=no_data_color, linewidths=linewidth / 2))
    known = [r for r in rows if r["speed"] is not None]
    drawn = LineCollection(line(known), cmap=cmap, linewidths=linewidth)
    drawn.set_array([r["speed"] for r in known])
    drawn.set_clim(low, high)
    ax.add_collection(drawn)
    ax.autoscale()
    fig.colorbar(drawn, label=f"speed ({SpeedUnit.parse(speed_unit).value})")
    fig.savefig(path, dpi=dpi)
    plt.close(fig)
    return path
