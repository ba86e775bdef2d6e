"""Node, lane and route graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.plans.numbering import number_rows
from wayloom.plans.scratch import Scratch


def grid_nodes(points: DataFrame, eps: float, x: str = "x", y: str = "y") -> DataFrame:
    """node x, y, n_points: equal points, or with eps the means of the points of a cell (rounded half to even)."""
    if eps <= 0:
        return points.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n_points"))
    cells = points.groupBy(F.rint(F.col(x) / eps).alias("gx"), F.rint(F.col(y) / eps).alias("gy"))
    return cells.agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count(F.lit(1)).alias("n_points")).select("x", "y", "n_points")


def incidence(links: DataFrame) -> DataFrame:
    """node_id, link_id, link_end, sign: +1 where the link starts, -1 where it ends."""
    ends = F.array(F.struct(F.col("u").alias("node_id"), F.lit("start").alias("link_end"), F.lit(1).alias("sign")), F.struct(F.col("v").alias("node_id"), F.lit("end").alias("link_end"), F.lit(-1).alias("sign")))
    return links.select("link_id", F.explode(ends).alias("e")).select("e.node_id", "link_id", "e.link_end", "e.sign").where("node_id is not null")


def node_lists(links: DataFrame) -> DataFrame:
    """node_id, n_start, n_end, links (sorted)."""
    return incidence(links).groupBy("node_id").agg(F.count_if(F.col("sign") > 0).alias("n_start"), F.count_if(F.col("sign") < 0).alias("n_end"), F.array_sort(F.collect_set("link_id")).alias("links"))


def degree_seeds(links: DataFrame, least: int) -> DataFrame:
    """node_id, degree, neighbours: parallel links once, loops not at all."""
    both = links.select(F.col("u").alias("node_id"), F.col("v").alias("other")).union(links.select("v", "u")).where("node_id <> other").distinct()
    return both.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"), F.array_sort(F.collect_set("other")).alias("neighbours")).where(F.col("degree") >= least)


def classify_nodes(links: DataFrame, laned: DataFrame) -> DataFrame:
    """node_id, n_ends, n_links, node_class by the ends of laned links: 3 and more a junction, 2 of two links a chain, 1 a dead end, the 2 of a loop none."""
    ends = incidence(links.join(laned.select("link_id").distinct(), "link_id", "left_semi"))
    n = ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_ends"), F.count_distinct("link_id").alias("n_links"))
    kind = F.when(F.col("n_ends") >= 3, "junction").when((F.col("n_ends") == 2) & (F.col("n_links") == 2), "chain").when(F.col("n_ends") == 1, "dead_end").otherwise("none")
    return n.withColumn("node_class", kind)


def junction_graph(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """link_id, u, v of the links both of whose ends are junctions; parallel ones stay."""
    j = nodes.where(F.col("node_class") == "junction").select("node_id")
    return (links.join(j.withColumnRenamed("node_id", "u"), "u", "left_semi").join(j.withColumnRenamed("node_id", "v"), "v", "left_semi").select("link_id", "u", "v"))


def missing_link_ends(points: DataFrame, links: DataFrame) -> DataFrame:
    """link_id, link_end: ends of links that no connection point covers."""
    need = links.select("link_id", F.explode(F.array(F.lit("start"), F.lit("end"))).alias("link_end")).distinct()
    return need.join(points.select("link_id", "link_end").distinct(), ["link_id", "link_end"], "left_anti")


def connector_graph(groups: DataFrame, undirected: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, undirected edges, directed edges) of lane groups between connectors.

    Groups: group_id, from_id, to_id, fx, fy, tx, ty, topo_len, poly_len, allowed. The weight is the given
    length, else the polyline's, else the chord. UNKNOWN directions go both ways
    if ``undirected``, else forward; NONE goes nowhere.
    """
    ends = F.array(F.struct(F.col("from_id").alias("connector_id"), F.col("fx").alias("x"), F.col("fy").alias("y")), F.struct(F.col("to_id").alias("connector_id"), F.col("tx").alias("x"), F.col("ty").alias("y")))
    nodes = groups.select("group_id", F.explode(ends).alias("e")).select("group_id", "e.*").where("connector_id is not null").groupBy("connector_id").agg(F.min_by(F.struct("x", "y"), "group_id").alias("p")).select("connector_id", "p.x", "p.y")
    good = lambda c: F.when(F.col(c) > 0, F.nanvl(F.col(c), F.lit(None).cast("double")))
    edges = groups.where("from_id is not null and to_id is not null").withColumn("weight", F.coalesce(good("topo_len"), good("poly_len"), F.hypot(F.col("tx") - F.col("fx"), F.col("ty") - F.col("fy"))))
    both = F.col("allowed") == "BOTH"
    unknown = F.col("allowed") == "UNKNOWN"
    fwd = edges.where(both | (F.col("allowed") == "FWD") | unknown).select("group_id", F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "weight")
    bwd = edges.where(both | (F.col("allowed") == "BWD") | (unknown & F.lit(undirected))).select("group_id", F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "weight")
    return nodes, edges.select("group_id", "from_id", "to_id", "weight"), fwd.union(bwd)


def lane_graph(lanes: DataFrame, eps: float = 0.0, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lanes: lane_id, sx, sy, ex, ey, dirs (array of FORWARD / BACKWARD; empty: no edge).

    Nodes are numbered from 0 by (x, y); weights are chords; of parallel edges the last counts.
    """
    q = (lambda c: F.rint(c / eps) * eps) if eps > 0 else (lambda c: c)
    moved = lanes.select("lane_id", "dirs", *[q(F.col(c)).alias(c) for c in ("sx", "sy", "ex", "ey")])
    points = moved.select(F.col("sx").alias("x"), F.col("sy").alias("y")).union(moved.select("ex", "ey")).distinct()
    scratch = scratch or Scratch(lanes.sparkSession, "lanes")
    nodes = scratch.cut(number_rows(points, [F.col("x"), F.col("y")], "node_id", scratch, start=0), "nodes")
    a = nodes.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("node_id").alias("s_node"))
    b = nodes.select(F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("node_id").alias("e_node"))
    e = moved.join(a, ["sx", "sy"]).join(b, ["ex", "ey"]).select("lane_id", F.explode("dirs").alias("dir"), "s_node", "e_node", F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")).alias("weight"))
    fwd = F.col("dir") == "FORWARD"
    e = e.select("lane_id", "dir", F.when(fwd, F.col("s_node")).otherwise(F.col("e_node")).alias("src"), F.when(fwd, F.col("e_node")).otherwise(F.col("s_node")).alias("dst"), "weight")
    return nodes, e.groupBy("src", "dst").agg(F.max_by(F.struct("lane_id", "dir", "weight"), F.struct("lane_id", "dir")).alias("l")).select("src", "dst", "l.lane_id", "l.dir", "l.weight")


def shortest_paths(spark: SparkSession, edges: DataFrame, sources: DataFrame, scratch: Scratch | None = None, max_rounds: int = 1000, max_cost: float | None = None) -> DataFrame:
    """node, dist, source, parent: cheapest way from any source (node) along directed edges (src, dst, weight >= 0).

    Rounds relax only the nodes that got better in the last one and end when none
    does; ties keep the smaller source and parent.
    """
    scratch = scratch or Scratch(spark, "paths")
    edges = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    best = scratch.cut(sources.select(F.col("node"), F.lit(0.0).alias("dist"), F.col("node").alias("source"), F.lit(None).cast("bigint").alias("parent")).distinct(), "best0")
    front = best
    for k in range(1, max_rounds + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"), "source", F.col("src").alias("parent"))
        if max_cost is not None:
            step = step.where(F.col("dist") <= max_cost)
        cand = best.withColumn("old", F.lit(True)).unionByName(step.withColumn("old", F.lit(False)))
        # an old entry wins a tie in length, so rounds end
        pick = cand.groupBy("node").agg(F.min(F.struct("dist", (~F.col("old")).alias("new"), "source", "parent")).alias("b")).select("node", "b.dist", "b.source", "b.parent", "b.new")
        pick = scratch.cut(pick, f"best{k}")
        front = pick.where("new").drop("new")
        best = pick.drop("new")
        if k > 2:
            scratch.drop(f"best{k - 2}")
        if front.isEmpty():
            return best
    raise RuntimeError("paths did not settle")


def path_to(spark: SparkSession, paths: DataFrame, target, scratch: Scratch | None = None) -> list:
    """Nodes from a source to ``target``; empty if it isn't reached. One lookup a node of the path."""
    out, at = [], target
    while at is not None:
        row = paths.where(F.col("node") == F.lit(at)).first()
        if row is None:
            return []
        out.append(at)
        at = row.parent
    return out[::-1]


def reachable(spark: SparkSession, edges: DataFrame, start: DataFrame, scratch: Scratch | None = None, reverse: bool = False) -> DataFrame:
    """node: what can be reached from the start nodes, themselves included."""
    e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else edges.select("src", "dst")
    return shortest_paths(spark, e.withColumn("weight", F.lit(1.0)), start, scratch).select("node")


def nodes_between(spark: SparkSession, edges: DataFrame, start: DataFrame, targets: DataFrame, every: bool = False) -> DataFrame:
    """node on some way from the start to any target, or to every one."""
    down = reachable(spark, edges, start)
    if not every:
        return down.join(reachable(spark, edges, targets, reverse=True), "node", "left_semi")
    out = down
    for r in targets.select("node").distinct().collect():  # the query's own targets
        one = spark.createDataFrame([(r.node,)], targets.select("node").schema)
        out = out.join(reachable(spark, edges, one, reverse=True), "node", "left_semi")
    return out


def leaf_nodes(edges: DataFrame) -> DataFrame:
    """node with one neighbour."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("o")).union(edges.select("dst", "src")).where("node <> o").distinct()
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node")


def best_targets(spark: SparkSession, edges: DataFrame, sources: DataFrame, targets: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, dist, hops_only: the targets (node) that can be reached, nearest first by weight; edges (src, dst, weight).

    Edges without a usable weight (null, NaN, negative) don't count for the weighted ways. Targets that only ways over such edges
    reach come after the others, by number of edges.
    """
    scratch = scratch or Scratch(spark, "targets")
    good = edges.where("weight >= 0 and not isnan(weight)")
    wanted = targets.select("node").distinct()
    paths = shortest_paths(spark, good, sources, scratch).join(wanted, "node", "left_semi").select("node", "dist")
    paths = scratch.cut(paths, "weighted")
    left = wanted.join(paths, "node", "left_anti")
    if not left.isEmpty():
        hops = shortest_paths(spark, edges.withColumn("weight", F.lit(1.0)), sources, scratch).join(left, "node", "left_semi")
        paths = paths.withColumn("hops_only", F.lit(False)).union(hops.select("node", "dist", F.lit(True)))
        return paths.orderBy("hops_only", "dist", "node")
    return paths.withColumn("hops_only", F.lit(False)).orderBy("dist", "node")


def lane_terminals(edges: DataFrame, lanes: DataFrame) -> DataFrame:
    """lane_id, starts, ends (sorted nodes): where a way may enter and leave each lane (lanes: lane_id; edges: src, dst, lane_id)."""
    own = edges.join(lanes.select("lane_id").distinct(), "lane_id", "left_semi").groupBy("lane_id")
    return own.agg(F.array_sort(F.collect_set("src")).alias("starts"), F.array_sort(F.collect_set("dst")).alias("ends"))


def nodes_by_distance(nodes: DataFrame, x: float, y: float) -> DataFrame:
    """node_id, dist, rank from 1: nodes (node_id, x, y) in order of distance from a place; ties by node_id."""
    d = nodes.select("node_id", F.hypot(F.col("x") - x, F.col("y") - y).alias("dist"))
    scratch = Scratch(nodes.sparkSession, "by-distance")
    return number_rows(d, [F.col("dist"), F.col("node_id")], "rank", scratch)


def path_length(path: DataFrame, edges: DataFrame) -> DataFrame:
    """One row total: the sum of the least weights between neighbours of a path (step, node)."""
    nxt = path.select((F.col("step") - 1).alias("step"), F.col("node").alias("dst"))
    best = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    return path.select("step", F.col("node").alias("src")).join(nxt, "step").join(best, ["src", "dst"]).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"))


def with_members(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Junction nodes (node_id) with cp_ids and lanes (sorted; empty without any) of the connection points (node_id, cp_id, lane_id) of their junction."""
    own = members.groupBy("node_id").agg(F.array_sort(F.collect_set("cp_id")).alias("cp_ids"), F.array_sort(F.collect_set("lane_id")).alias("lanes"))
    kinds = own.schema
    none = lambda c: F.coalesce(c, F.array().cast(kinds[c].dataType)).alias(c)
    return nodes.join(own, "node_id", "left").select(*nodes.columns, none("cp_ids"), none("lanes"))
