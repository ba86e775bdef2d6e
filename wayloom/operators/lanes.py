"""Lane geometry joined with attributes, and lanes oriented along links and chains."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.functions import polyline


def attach_lane_attributes(lanes: DataFrame, attrs: DataFrame) -> DataFrame:
    """Left join on (lane_group_ref, number) = (group_id, lane_no); lanes without attributes have nulls."""
    a = attrs.select(F.col("group_id").alias("lane_group_ref"), F.col("lane_no").alias("number"), *[c for c in attrs.columns if c not in ("group_id", "lane_no")])
    return lanes.join(a, ["lane_group_ref", "number"], "left")


def attach_boundaries(lanes: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Left and right boundary lines by their numbers in the lane's group."""
    out = lanes
    for side in ("left", "right"):
        b = boundaries.select("lane_group_ref", F.col("number").alias(f"{side}_boundary"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))
        out = out.join(b, ["lane_group_ref", f"{side}_boundary"], "left")
    return out


def endpoint_pairs(ends: DataFrame) -> DataFrame:
    """a, b: undirected pairs of the nodes at a lane's start and end (lane_id, endpoint, node_id)."""
    p = ends.groupBy("lane_id").agg(F.min(F.when(F.col("endpoint") == "start", F.col("node_id"))).alias("s"), F.min(F.when(F.col("endpoint") == "end", F.col("node_id"))).alias("e"))
    return p.where("s is not null and e is not null").select(F.least("s", "e").alias("a"), F.greatest("s", "e").alias("b")).distinct()


def node_lane_lists(ends: DataFrame) -> DataFrame:
    """node_id, lanes (sorted), n_start, n_end."""
    return ends.groupBy("node_id").agg(F.array_sort(F.collect_set("lane_id")).alias("lanes"), F.count_if(F.col("endpoint") == "start").alias("n_start"), F.count_if(F.col("endpoint") == "end").alias("n_end"))


def link_directions(links: DataFrame, bridge: DataFrame, node_out: DataFrame, node_in: DataFrame) -> DataFrame:
    """link_id, dir, src, dst: a direction exists where lane groups of the link leave its source and enter its target.

    node_out and node_in: node_id, lane_group_id.
    """
    both = links.select("link_id", F.lit("FORWARD").alias("dir"), F.col("u").alias("src"), F.col("v").alias("dst")).union(links.select("link_id", F.lit("BACKWARD"), "v", "u"))
    own = both.join(bridge.distinct(), "link_id")
    leaves = own.join(node_out.withColumnRenamed("node_id", "src"), ["src", "lane_group_id"], "left_semi").select("link_id", "dir").distinct()
    enters = own.join(node_in.withColumnRenamed("node_id", "dst"), ["dst", "lane_group_id"], "left_semi").select("link_id", "dir").distinct()
    return both.join(leaves, ["link_id", "dir"], "left_semi").join(enters, ["link_id", "dir"], "left_semi")


def orient_and_trim(lanes: DataFrame) -> DataFrame:
    """``lanes`` (points, sx, sy, ex, ey of the points to join) with points turned and cut to run from the one nearest the start to the one nearest the end."""
    start, end = polyline.point(F.col("sx"), F.col("sy")), polyline.point(F.col("ex"), F.col("ey"))
    turned = lanes.withColumn("points", polyline.orient(F.col("points"), start, end))
    index = F.sequence(F.lit(0), F.size("points") - 1)

    def nearest(x: str, y: str):
        d = F.transform(index, lambda i: F.struct(F.hypot(F.get("points", i)["x"] - F.col(x), F.get("points", i)["y"] - F.col(y)).alias("d"), i.alias("i")))
        return F.array_min(d)["i"]

    t = turned.where(F.size("points") > 0).withColumn("_a", nearest("sx", "sy")).withColumn("_b", nearest("ex", "ey"))
    return t.withColumn("points", F.when(F.col("_b") > F.col("_a"), F.slice("points", F.col("_a") + 1, F.col("_b") - F.col("_a") + 1)).otherwise(F.col("points"))).drop("_a", "_b")


def chains(links: DataFrame, classes: DataFrame) -> DataFrame:
    """chain_id, pos, link_id, u, v: links in a row between nodes that aren't chain nodes, walked from the smaller end; closed rings have none.

    A chain is walked in one task; its length is that of a road between junctions.
    """
    from wayloom.operators.components import connected_components

    kind = classes.select(F.col("node_id"), "node_class")
    ends = links.select("link_id", F.explode(F.array("u", "v")).alias("node_id")).join(kind, "node_id", "left")
    through = ends.where("node_class = 'chain'").select("link_id", "node_id")
    pairs = through.groupBy("node_id").agg(F.min("link_id").alias("src"), F.max("link_id").alias("dst")).select("src", "dst").union(links.select("link_id", "link_id"))
    label = connected_components(links.sparkSession, pairs).select(F.col("id").alias("link_id"), F.col("component").alias("chain_id"))
    outer = ends.where("node_class is null or node_class <> 'chain'").select("link_id", F.col("node_id").alias("stop")).distinct().groupBy("link_id").agg(F.array_sort(F.collect_set("stop")).alias("stops"))
    rows = links.select("link_id", "u", "v").join(label, "link_id").join(outer, "link_id", "left")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        at: dict[int, list[int]] = {}
        for k, (u, v) in enumerate(zip(pdf.u, pdf.v, strict=True)):
            at.setdefault(u, []).append(k)
            at.setdefault(v, []).append(k)
        starts = sorted({int(s) for stops in pdf.stops if stops is not None for s in stops})
        out: list[tuple] = []
        if starts:
            node, used = starts[0], set()
            while True:
                step = next((k for k in at.get(node, []) if k not in used), None)
                if step is None:
                    break
                used.add(step)
                u, v = int(pdf.u.iloc[step]), int(pdf.v.iloc[step])
                other = v if u == node else u
                out.append((int(pdf.chain_id.iloc[0]), len(out), int(pdf.link_id.iloc[step]), node, other))
                node = other
        return pd.DataFrame(out, columns=["chain_id", "pos", "link_id", "u", "v"])

    return rows.groupBy("chain_id").applyInPandas(walk, "chain_id long, pos long, link_id long, u long, v long")


def superlinks(chain_rows: DataFrame, bridge: DataFrame) -> DataFrame:
    """chain_id, src, dst, links (in order), corridor groups: the groups of inner links that neither end link has."""
    w = F.struct("pos", "link_id")
    s = chain_rows.groupBy("chain_id").agg(F.min_by("u", "pos").alias("src"), F.max_by("v", "pos").alias("dst"), F.array_sort(F.collect_list(w)).alias("_l"), F.min("pos").alias("_a"), F.max("pos").alias("_b"))
    own = chain_rows.join(bridge.distinct(), "link_id").join(s.select("chain_id", "_a", "_b"), "chain_id")
    edge = (F.col("pos") == F.col("_a")) | (F.col("pos") == F.col("_b"))
    groups = own.groupBy("chain_id", "lane_group_id").agg(F.bool_or(edge).alias("e")).where("not e").groupBy("chain_id").agg(F.array_sort(F.collect_set("lane_group_id")).alias("corridor"))
    return s.join(groups, "chain_id", "left").select("chain_id", "src", "dst", F.transform("_l", lambda r: r["link_id"]).alias("links"), F.coalesce("corridor", F.array()).alias("corridor"))


def order_along(points: DataFrame, backbone_pos: str = "s") -> DataFrame:
    """Lanes of a chain numbered by their place along the backbone."""
    return points.withColumn("order", F.row_number().over(Window.partitionBy("chain_id").orderBy(backbone_pos, "lane_id")))


def edge_attributes(edges: DataFrame, summary: DataFrame) -> DataFrame:
    """Edges (edge_id, links in order) with the summary of the first link that has one."""
    e = edges.select("edge_id", F.posexplode("links").alias("pos", "link_id")).join(summary, "link_id")
    best = e.groupBy("edge_id").agg(F.min_by(F.struct(*summary.columns), "pos").alias("s")).select("edge_id", *[F.col(f"s.{c}").alias(c) for c in summary.columns])
    return edges.join(best, "edge_id", "left")
