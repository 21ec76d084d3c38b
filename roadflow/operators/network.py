"""Road networks as DataFrames: directed edges, nodes, short pieces for snapping, and their arrays for kernels."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadflow.functions import geo
from roadflow.functions.parse import oneway, parse_maxspeed
from roadflow.kernels import geodesy
from roadflow.kernels.graph import Graph
from roadflow.kernels.snap import Pieces
from roadflow.report import Report
from roadflow.session import ship_package

PIECE_M = 25.0
#: Edges up to which a network's arrays are broadcast (about 0.5 kB each); beyond it the kernels refuse, and snapping joins instead.
MOST_EDGES = 2_000_000
# Names of edge columns of the public result.
#: Edge columns of our own; a source property of one of these names is kept as <name>_src.
RESERVED = ("edge_id", "length_m", "geometry", "lon", "lat", "obs_speed_mps", "travel_time_s")
_CHUNK = 100_000

RECORDS = "record_no long, coords array<struct<lon:double,lat:double>>, props map<string,string>"


def _numbered(records: DataFrame) -> DataFrame:
    """records with first_edge: how many edges the records before have. Sums by chunk of record numbers, so no task sees all rows."""
    chunk = records.withColumn("__chunk", F.floor(F.col("record_no") / _CHUNK))
    sums = chunk.groupBy("__chunk").agg(F.sum("n_edges").alias("__n"))
    sums = sums.withColumn("__base", F.sum("__n").over(Window.orderBy("__chunk")) - F.col("__n")).drop("__n")
    within = Window.partitionBy("__chunk").orderBy("record_no").rowsBetween(Window.unboundedPreceding, -1)
    return chunk.join(sums, "__chunk").withColumn("first_edge", F.col("__base") + F.coalesce(F.sum("n_edges").over(within), F.lit(0))).drop("__chunk", "__base")


def _line_length(xy: Column) -> Column:
    pairs = F.arrays_zip(F.slice(xy, F.lit(1), F.size(xy) - 1).alias("a"), F.slice(xy, F.lit(2), F.size(xy) - 1).alias("b"))
    square = lambda p, c: (p["b"][c] - p["a"][c]) * (p["b"][c] - p["a"][c])
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.sqrt(square(p, "x") + square(p, "y")))


def _rounded(c: Column) -> Column:
    return F.bround(c, 7)


@dataclass
class Network:
    """edges: edge_id, u, v (node ids), length_m, xy and lonlat (vertices), reverse_id, road_id (the smaller of an edge's two ids), maxspeed_mps, props."""

    edges: DataFrame
    nodes: DataFrame
    zone: int
    north: bool
    #: What was left out; its warnings come after an action.
    report: Report | None = field(default=None, repr=False)
    _arrays: tuple[Broadcast, dict] | None = field(default=None, repr=False)

    # ------------------------------------------------------------ construction

    @classmethod
    def from_records(cls, records: DataFrame, *, metric_epsg: int | None = None, directed: bool = True, oneway_attr: str = "oneway", length_attr: str | None = None) -> Network:
        """records: RECORDS, in the order of record_no. The metric system is that of the first vertex unless it is given.

        Closed loops are left out, as are records of fewer than two vertices.
        """
        if metric_epsg is None:
            first = records.filter(F.size("coords") > 1).select("record_no", F.col("coords")[0].alias("c")).agg(F.min_by("c", "record_no").alias("c")).first()["c"]
            if first is None:
                raise ValueError("the network has no line")
            metric_epsg = geo.utm_epsg_for(first["lon"], first["lat"])
        zone, north = geo.utm_zone_of(metric_epsg)
        ship_package(records.sparkSession)

        ends = {k: F.struct(_rounded(F.col("coords")[i]["lon"]).alias("lon"), _rounded(F.col("coords")[i]["lat"]).alias("lat")) for k, i in (("a", F.lit(0)), ("b", F.size("coords") - 1))}
        report = Report()
        r = report.watch(records, n_without_line=(F.col("coords").isNull() | (F.size("coords") < 2), "records are left out: a line has two vertices at least"))
        r = report.watch(r.filter(F.size("coords") > 1).withColumns(ends), n_loops=(F.col("a") == F.col("b"), "records are left out: they end where they start")).filter("a <> b")
        way = oneway(F.try_element_at("props", F.lit(oneway_attr))) if directed else F.lit(0)
        r = r.withColumn("way", way).withColumn("n_edges", F.when(F.col("way") == 0, 2).otherwise(1)).withColumn("xy", geo.utm_of_points(F.col("coords"), zone, north))
        own = F.try_element_at("props", F.lit(length_attr)).try_cast("double") if length_attr else F.lit(None).cast("double")
        r = _numbered(r.withColumn("length_m", F.coalesce(own, _line_length(F.col("xy")))))
        limit = F.coalesce(F.try_element_at("props", F.lit("maxspeed_mps")).try_cast("double"), parse_maxspeed(F.try_element_at("props", F.lit("maxspeed"))))
        props = F.transform_keys("props", lambda k, _: F.when(k.isin(*RESERVED), F.concat(k, F.lit("_src"))).otherwise(k))
        turn = lambda c, back: F.reverse(c) if back else F.col(c)

        def one(back: bool) -> Column:
            first = F.col("first_edge")
            both = F.col("way") == 0
            mine = F.when(both, first + 1).otherwise(first) if back else first
            other = F.when(both, first if back else first + 1)
            start, end = ("b", "a") if back else ("a", "b")
            return F.struct(mine.cast("long").alias("edge_id"), F.col(start).alias("from"), F.col(end).alias("to"), turn("xy", back).alias("xy"), turn("coords", back).alias("lonlat"), other.cast("long").alias("reverse_id"))

        e = r.withColumn("e", F.explode(F.when(F.col("way") == 1, F.array(one(False))).when(F.col("way") == -1, F.array(one(True))).otherwise(F.array(one(False), one(True)))))
        e = e.select("e.*", "length_m", limit.alias("maxspeed_mps"), props.alias("props"), "record_no")
        touched = e.select(F.explode(F.array(F.struct(F.col("from").alias("at"), (2 * F.col("edge_id")).alias("id")), F.struct(F.col("to").alias("at"), (2 * F.col("edge_id") + 1).alias("id")))).alias("t"))
        nodes = touched.groupBy("t.at").agg(F.min("t.id").alias("node_id"))  # a node's id is that of its first mention
        for k, c in (("u", "from"), ("v", "to")):
            e = e.join(nodes.select(F.col("at").alias(c), F.col("node_id").alias(k)), c)
        e = e.select("edge_id", "u", "v", "length_m", "xy", "lonlat", "reverse_id", F.least("edge_id", F.coalesce("reverse_id", "edge_id")).alias("road_id"), "maxspeed_mps", "props")
        # kept for all that is asked of a network; a lost part is worked out again
        return cls(e.persist(), nodes.select("node_id", "at.lon", "at.lat").persist(), zone, north, report=report)

    @classmethod
    def from_geojson(cls, spark: SparkSession, path: str, **options) -> Network:
        from roadflow.sources.networks import read_geojson_lines

        return cls.from_records(read_geojson_lines(spark, path, by_line=options.pop("by_line", False)), **options)

    @classmethod
    def from_overpass_json(cls, spark: SparkSession, path: str, **options) -> Network:
        from roadflow.sources.networks import read_overpass

        return cls.from_records(read_overpass(spark, path), **options)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, *, layer: str | None = None, **options) -> Network:
        """A Shapefile or GeoPackage, if pyogrio and shapely are installed."""
        from roadflow.sources.networks import read_vector_file

        return cls.from_records(read_vector_file(spark, path, layer), **options)

    @classmethod
    def from_overpass(cls, spark: SparkSession, bbox, path: str, *, highway_regex: str | None = None, url: str | None = None, timeout: float = 90.0, **options) -> Network:
        """Drivable ways of a bounding box from a map service; its answer is kept at ``path``."""
        from roadflow.sources.networks import fetch_network

        return cls.from_overpass_json(spark, fetch_network(bbox, path, highway_regex=highway_regex, url=url, timeout=timeout), **options)

    def with_edges(self, edges: DataFrame) -> Network:
        """The same network with other columns on its edges."""
        return Network(edges, self.nodes, self.zone, self.north, self.report, self._arrays)

    # ------------------------------------------------------------ parts

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return geo.utm_forward(lon, lat, self.zone, self.north)

    def segments(self, piece_m: float = PIECE_M) -> DataFrame:
        """edge_id, seg_no, x0, y0, x1, y1, arc0: edges cut into pieces of at most ``piece_m``."""
        n = F.size("xy")
        e = self.edges.select("edge_id", F.posexplode(F.arrays_zip(F.slice("xy", F.lit(1), n - 1).alias("a"), F.slice("xy", F.lit(2), n - 1).alias("b"))).alias("pos", "p"))
        e = e.select("edge_id", "pos", *(F.col(f"p.{k}.{c}").alias(f"{c}{i}") for i, k in enumerate("ab") for c in "xy"))
        e = e.withColumn("len", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
        before = Window.partitionBy("edge_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        e = e.withColumn("arc", F.coalesce(F.sum("len").over(before), F.lit(0.0))).withColumn("m", F.greatest(F.lit(1), F.ceil(F.col("len") / piece_m).cast("int")))
        e = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        at = lambda a, b, k: F.col(a) + (k / F.col("m")) * (F.col(b) - F.col(a))
        k, k1 = F.col("k"), F.col("k") + 1
        return e.select(
            "edge_id", (F.col("pos") * 1_000_000 + k).cast("long").alias("seg_no"), at("x0", "x1", k).alias("x0"), at("y0", "y1", k).alias("y0"),
            F.when(k1 == F.col("m"), F.col("x1")).otherwise(at("x0", "x1", k1)).alias("x1"), F.when(k1 == F.col("m"), F.col("y1")).otherwise(at("y0", "y1", k1)).alias("y1"), (F.col("arc") + k / F.col("m") * F.col("len")).alias("arc0"),
        )

    def node_pairs(self, undirected: bool = False) -> DataFrame:
        """The shortest edge between each ordered (or unordered) pair of nodes."""
        a, b = (F.least("u", "v"), F.greatest("u", "v")) if undirected else (F.col("u"), F.col("v"))
        return self.edges.groupBy(a.alias("u"), b.alias("v")).agg(F.min("length_m").alias("length_m"), F.min_by("edge_id", F.struct("length_m", "edge_id")).alias("edge_id"))

    def edges_between(self, x: int, y: int) -> DataFrame:
        """Edges from either node to the other."""
        return self.edges.filter(((F.col("u") == x) & (F.col("v") == y)) | ((F.col("u") == y) & (F.col("v") == x))).select("edge_id", "length_m")

    def edge(self, edge_id: int):
        """One edge as a Row: ends, length, vertices, limit and properties."""
        row = self.edges.filter(F.col("edge_id") == edge_id).first()
        if row is None:
            raise KeyError(edge_id)
        return row

    def counts(self) -> tuple[int, int]:
        """Edges and nodes."""
        return self.edges.count(), self.nodes.count()

    def road_edge_ids(self, edge_id: int) -> DataFrame:
        return self.edges.filter(F.col("road_id") == self.edges.filter(F.col("edge_id") == edge_id).select("road_id").first()[0]).select("edge_id")

    # ------------------------------------------------------------ arrays for kernels

    def graph(self) -> Broadcast:
        """The edges as arrays on every executor: ids, ends, lengths, vertices. Refused beyond MOST_EDGES."""
        if self._arrays is None:
            spark = self.edges.sparkSession
            ship_package(spark)
            n = self.edges.count()
            if n > MOST_EDGES:
                raise ValueError(f"{n} edges are more than the {MOST_EDGES} that are sent to every executor")
            got = self.edges.select("edge_id", "u", "v", "length_m", "reverse_id", "xy").orderBy("edge_id").toArrow().combine_chunks()
            node_ids, ends = np.unique(np.concatenate([got.column("u").to_numpy(), got.column("v").to_numpy()]), return_inverse=True)
            xy = got.column("xy").combine_chunks()
            xy = xy.chunk(0) if hasattr(xy, "chunk") and xy.num_chunks else xy
            flat = xy.flatten() if n else None
            points = np.column_stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)]) if n else np.zeros((0, 2))
            start = np.concatenate([[0], np.cumsum(np.asarray(xy.value_lengths(), np.int64))]) if n else np.zeros(1, np.int64)
            reverse = got.column("reverse_id").fill_null(-1).to_numpy().astype(np.int64)
            if n and not (got.column("edge_id").to_numpy() == np.arange(n)).all():
                raise ValueError("edge ids must run from 0 without gaps")
            graph = Graph(u=ends[:n], v=ends[n:], length=got.column("length_m").to_numpy(), reverse=reverse, xy=points, start=start, nodes=len(node_ids))
            lonlat = self.nodes.orderBy("node_id").toArrow()
            order = np.empty(len(node_ids), np.int64)
            order[np.lexsort((lonlat.column("lat").to_numpy(), lonlat.column("lon").to_numpy()))] = np.arange(len(node_ids))
            payload = {"graph": graph, "node_ids": node_ids, "order": order, "zone": self.zone, "north": self.north}
            self._arrays = (spark.sparkContext.broadcast(payload), {})
        return self._arrays[0]

    def pieces(self, reach: float) -> Broadcast:
        """The grid of pieces for snapping within ``reach``, on every executor."""
        shared = self.graph()
        kept = self._arrays[1]
        if reach not in kept:
            kept[reach] = self.edges.sparkSession.sparkContext.broadcast(Pieces(*shared.value["graph"].pieces(PIECE_M), reach, PIECE_M))
        return kept[reach]


def project_arrays(shared: dict, lon, lat) -> tuple[np.ndarray, np.ndarray]:
    return geodesy.utm(lon, lat, shared["zone"], shared["north"])


def props_of(json_text: str) -> dict[str, str]:
    """Properties as strings, as they stand in the edges' props."""
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in json.loads(json_text).items() if v is not None}
