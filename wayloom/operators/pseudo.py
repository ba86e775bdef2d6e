"""Links made from lane-group geometry, where the tiles have none: best line of each link, ends snapped to nodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.operators.components import connected_components
from wayloom.operators.spatial import range_join
from wayloom.plans.scratch import Scratch

#: Fixed value: half a side of the box, in degrees, within which an end takes a node that is there already.
SNAP = 5e-5


def snapped(spark: SparkSession, ends: DataFrame, nodes: DataFrame | None = None, snap: float = SNAP, scratch: Scratch | None = None) -> DataFrame:
    """end_id, node_id, lat, lon: ends (end_id, no, lat, lon) taken in order of ``no``, each at the first node made within the box, else a node of its own.

    nodes: node_id, no, lat, lon of those that are there before, in order. Ends interact only with what lies in their
    box, so each connected group of near ends is gone through on its own.
    """
    scratch = scratch or Scratch(spark, "snap")
    own = ends.select(F.col("end_id").cast("string").alias("id"), "no", "lat", "lon", F.lit(False).alias("given"))
    if nodes is not None:
        own = own.union(nodes.where("lat is not null").select(F.col("node_id").cast("string"), "no", "lat", "lon", F.lit(True)))
    key = F.concat(F.col("given").cast("int").cast("string"), F.lit(":"), F.col("id"))
    own = scratch.cut(own.withColumn("key", key), "ends")
    right = own.select(F.col("key").alias("key2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    near = range_join(own.select("key", "lat", "lon"), right, 1.5 * snap, "lon", "lat", "lon2", "lat2").where("key <= key2").select("key", "key2")
    label = connected_components(spark, near, "key", "key2", scratch).withColumnRenamed("id", "key")

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["given", "no", "id"], ascending=[False, True, True])
        made: list[tuple[str, float, float]] = []
        out = []
        for r in pdf.itertuples():
            hit = None if r.given else next((m for m in made if abs(m[1] - r.lat) < snap and abs(m[2] - r.lon) < snap), None)
            if hit is None:
                hit = (r.id, r.lat, r.lon)
                made.append(hit)
            if not r.given:
                out.append((r.id, *hit))
        return pd.DataFrame(out, columns=["end_id", "node_id", "lat", "lon"]).astype({"lat": "float64", "lon": "float64"})

    return own.join(label, "key").groupBy("component").applyInPandas(rule, "end_id string, node_id string, lat double, lon double")


def pseudo_links(spark: SparkSession, bridge: DataFrame, geometry: DataFrame, nodes: DataFrame | None = None, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(links: link_id, u, v, lat, lon; nodes: node_id, lat, lon that were made).

    bridge: link_id, link_no (order of the links), group_no (order within a link), lane_group_id. geometry: lane_group_id,
    no, lat, lon (arrays; the first of a group counts). A link takes the line with the most points, the first of equal ones; new nodes
    are ps_<link>_s and ps_<link>_e.
    """
    scratch = scratch or Scratch(spark, "pseudo")
    lines = geometry.where(F.size("lat") > 0).groupBy("lane_group_id").agg(F.min_by(F.struct("lat", "lon"), "no").alias("g"))
    best = bridge.join(lines, "lane_group_id").groupBy("link_id").agg(F.min("link_no").alias("link_no"), F.max_by("g", F.struct(F.size("g.lat"), -F.col("group_no"))).alias("g"))
    best = scratch.cut(best.select(F.col("link_id").cast("string").alias("link_id"), "link_no", "g.lat", "g.lon"), "lines")
    end = lambda mark, k, at: best.select(F.concat(F.lit("ps_"), F.col("link_id"), F.lit(mark)).alias("end_id"), (F.col("link_no") * 2 + k).alias("no"), F.element_at("lat", at).alias("lat"), F.element_at("lon", at).alias("lon"))
    at = scratch.cut(snapped(spark, end("_s", 0, 1).union(end("_e", 1, -1)), nodes, scratch=scratch), "snapped")
    to = lambda mark, c: at.where(F.endswith("end_id", F.lit(mark))).select(F.expr(f"substring(end_id, 4, length(end_id) - {3 + len(mark)})").alias("link_id"), F.col("node_id").alias(c))
    links = best.join(to("_s", "u"), "link_id").join(to("_e", "v"), "link_id").select("link_id", "u", "v", "lat", "lon")
    return links, at.where("node_id = end_id").select("node_id", "lat", "lon")
