"""Views of a map: rectangles, what lies in them, and the line that stands for a link."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import geodesy

POINTS = "array<struct<x:double,y:double>>"


def view(links: DataFrame, nodes: DataFrame, rect: tuple[float, float, float, float] | None) -> tuple[DataFrame, DataFrame]:
    """(link_id, node_id) tables of a view: links (link_id, u, v) that start or end in it, and their end nodes, in it or not.

    nodes: node_id, lat, lon. Without a rectangle everything is in view.
    """
    if rect is None:
        return links.select("link_id"), nodes.select("node_id")
    near = nodes.where(geodesy.in_rectangle(F.col("lat"), F.col("lon"), *rect)).select("node_id").distinct()
    ends = links.select("link_id", F.explode(F.array("u", "v")).alias("node_id"))
    own = ends.join(near, "node_id", "left_semi").select("link_id").distinct()
    return own, ends.join(own, "link_id", "left_semi").where("node_id is not null").select("node_id").distinct()


def nodes_in_box(nodes: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """Nodes (x, y) in (x0, y0, x1, y1), edges included; all without a box."""
    return nodes if box is None else nodes.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def edges_in_box(edges: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float] | None, mode: str = "both") -> DataFrame:
    """Edges (src, dst) with both ends in the box, or with ``mode`` "either" one at least."""
    if mode not in ("both", "either"):
        raise ValueError(f"mode is both or either, not {mode}")
    if box is None:
        return edges
    own = nodes_in_box(nodes, box).select("node_id", F.lit(True).alias("_in")).distinct()
    both = edges.join(own.withColumnsRenamed({"node_id": "src", "_in": "_a"}), "src", "left").join(own.withColumnsRenamed({"node_id": "dst", "_in": "_b"}), "dst", "left")
    a, b = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    return both.where(a & b if mode == "both" else a | b).select(*edges.columns)


def enu_box(spark: SparkSession, lat_lon: tuple[float, float, float, float], lat0: float, lon0: float, h0: float = 0.0) -> DataFrame:
    """One row x0, y0, x1, y1: the box in metres around the origin that holds the four corners of (lat0, lon0, lat1, lon1)."""
    a, b, c, d = (F.lit(float(v)) for v in lat_lon)
    corners = geodesy.project_polyline(F.array(a, a, c, c), F.array(b, d, b, d), F.array(F.lit(0)), F.lit(lat0), F.lit(lon0), F.lit(h0))
    xs, ys = F.transform("p", lambda q: q["x"]), F.transform("p", lambda q: q["y"])
    return spark.range(1).select(corners.alias("p")).select(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def link_lines(links: DataFrame, nodes: DataFrame, lat0: float, lon0: float, h0: float = 0.0) -> DataFrame:
    """link_id, points, first, last.

    links: link_id, u, v, lat, lon (arrays). nodes: node_id, lat, lon. The line is the link's own where it has two
    points or more and as many latitudes as longitudes, else from node to node, else empty; finite points only, 64 at most.
    first and last are the nodes' places where both are known, else the line's ends, else null.
    """
    from wayloom.functions.polyline import finite_points, subsample

    xy = lambda lat, lon: geodesy.project_polyline(lat, lon, F.array(F.lit(0)), F.lit(lat0), F.lit(lon0), F.lit(h0))
    at = lambda i: nodes.where("lat is not null and lon is not null").select(F.col("node_id").alias(i), F.struct("lat", "lon").alias(f"_{i}"))
    d = links.join(at("u"), "u", "left").join(at("v"), "v", "left")
    own = (F.size("lat") >= 2) & (F.size("lat") == F.size("lon"))
    known = F.col("_u").isNotNull() & F.col("_v").isNotNull()
    ends = F.when(known, xy(F.array("_u.lat", "_v.lat"), F.array("_u.lon", "_v.lon")))
    d = d.withColumn("_ends", ends).withColumn("points", F.when(own, xy(F.col("lat"), F.col("lon"))).otherwise(F.coalesce("_ends", F.array().cast(POINTS))))
    d = d.withColumn("points", subsample(finite_points(F.col("points"))))
    line = F.when(F.size("points") >= 2, F.col("points"))
    return d.select("link_id", "points", F.coalesce(F.get("_ends", F.lit(0)), F.get(line, F.lit(0))).alias("first"), F.coalesce(F.get("_ends", F.lit(1)), F.try_element_at(line, F.lit(-1))).alias("last"))
