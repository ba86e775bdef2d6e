"""Routes over the lane graph: snapping, goals in order of distance, enriched steps, stitched geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.operators.graphs import path_to, shortest_paths
from wayloom.operators.spatial import k_nearest, project_points, range_join, segments
from wayloom.plans.scratch import Scratch


def _pieces(lanes: DataFrame, most: float) -> DataFrame:
    """The segments of lanes, each repeated for every part of at most ``most`` metres, with the part's middle (mx, my)."""
    seg = segments(lanes).withColumn("_n", F.greatest(F.ceil(F.col("seg_len") / F.lit(float(most))), F.lit(1)))
    seg = seg.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    f = (F.col("_i") + 0.5) / F.col("_n")
    return seg.withColumn("mx", F.col("ax") + (F.col("bx") - F.col("ax")) * f).withColumn("my", F.col("ay") + (F.col("by") - F.col("ay")) * f)


def _ranked(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "line_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("line_id", "lane_id")


def snap_to_lanes(queries: DataFrame, lanes: DataFrame, k: int = 1, radius: float | None = None, reach: float = 50.0, scratch: Scratch | None = None) -> DataFrame:
    """query_id, lane_id, dist, s, frac, fx, fy, rank: the k closest lanes of each query by exact distance, ties by lane_id.

    queries: query_id, px, py. lanes: line_id, points. With ``radius`` lanes farther off are left out; without
    it there is no limit: queries with fewer than k lanes within ``reach`` are searched again within the distance
    of their k-th nearest lane middle, which can't be nearer than their k-th lane. With fewer than k lanes a
    query gets all. Long segments are found by their parts, so reach doesn't follow the longest one.
    """
    queries = queries.select("query_id", "px", "py")
    first = reach if radius is None else radius
    pieces = _pieces(lanes, first)
    within = project_points(range_join(queries, pieces, first * 1.5, "px", "py", "mx", "my").drop("dist"), "query_id").where(F.col("dist") <= first)
    if radius is not None:
        return _ranked(within, k)
    scratch = scratch or Scratch(queries.sparkSession, "snap")
    pieces, near = scratch.cut(pieces, "pieces"), scratch.cut(_ranked(within, k), "near")
    done = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    far = scratch.cut(queries.join(done, "query_id", "left_anti"), "far")
    if far.isEmpty():
        return near
    middle = pieces.groupBy("line_id").agg(F.min(F.struct(F.abs(F.col("s0") + F.col("seg_len") / 2 - F.col("total") / 2), "mx", "my")).alias("m"))
    middle = middle.select(F.col("line_id").alias("p_id"), F.col("m.mx").alias("x"), F.col("m.my").alias("y"))
    to = k_nearest(far.select(F.col("query_id").alias("q_id"), F.col("px").alias("qx"), F.col("py").alias("qy")), middle, k, reach, scratch=scratch)
    to = to.groupBy(F.col("q_id").alias("query_id")).agg(F.max("dist").alias("until"))
    to = far.join(to, "query_id").withColumn("step", F.ceil(F.log2(F.greatest(F.col("until") * (1 + 1e-9), F.lit(first)))).cast("int"))
    to = scratch.cut(to, "until")
    found = near.join(done, "query_id", "left_semi")
    for r in sorted(r.step for r in to.select("step").distinct().collect()):  # distances double: tens at most
        part = range_join(to.where(F.col("step") == r).drop("step", "until"), pieces, 2.0**r + first / 2, "px", "py", "mx", "my").drop("dist")
        found = found.unionByName(_ranked(project_points(part, "query_id"), k))
    return found


def nearest_node(queries: DataFrame, nodes: DataFrame, cell: float = 50.0) -> DataFrame:
    """query_id, node_id, dist."""
    q = queries.select(F.col("query_id").alias("q_id"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    return k_nearest(q, nodes.select(F.col("node_id").alias("p_id"), "x", "y"), 1, cell).select(F.col("q_id").alias("query_id"), F.col("p_id").alias("node_id"), "dist")


def path_edges(path: DataFrame, edges: DataFrame) -> DataFrame:
    """step, src, dst, lane_id, weight from path rows (step, node): the cheapest edge of each pair of neighbours."""
    nxt = path.select((F.col("step") - 1).alias("step"), F.col("node").alias("dst"))
    steps = path.select("step", F.col("node").alias("src")).join(nxt, "step")
    own = steps.join(edges, ["src", "dst"])
    return own.groupBy("step", "src", "dst").agg(F.min_by(F.struct("lane_id", "weight"), F.struct("weight", "lane_id")).alias("e")).select("step", "src", "dst", "e.lane_id", "e.weight")


def route(spark: SparkSession, start: tuple[float, float], goal: tuple[float, float], lanes: DataFrame, edges: DataFrame, k_goals: int = 8, radius: float | None = 50.0,
          attributes: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """step, src, dst, lane_id, weight (and lane attributes) of the cheapest way from the lane nearest the start to the first lane, in order of distance from the goal, that can be reached.

    lanes: line_id, points. edges: src, dst, lane_id, weight. ``radius`` None: lanes at any distance.
    With ``nodes`` (node_id, x, y) the way begins and ends at the nearest node of the graph where the lane nearest the start, or
    every goal lane, has no edges. Raises if no goal is routable.
    """
    scratch = Scratch(spark, "route")
    edges = scratch.cut(edges.select("src", "dst", "lane_id", "weight"), "edges")
    q = spark.createDataFrame([(0, float(start[0]), float(start[1])), (1, float(goal[0]), float(goal[1]))], "query_id int, px double, py double")
    snapped = snap_to_lanes(q, lanes, k_goals, radius).select("query_id", "lane_id", "rank").collect()  # k_goals rows each
    first = [r.lane_id for r in snapped if r.query_id == 0 and r["rank"] == 1]
    if not first and nodes is None:
        raise LookupError("no lane near the start")
    used = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()

    def ends(lane_ids: list, side: str, query: int) -> list[DataFrame]:
        """The nodes of each lane that has edges; the graph's nearest node where none has."""
        of = [edges.where(F.col("lane_id") == F.lit(i)).select(F.col(side).alias("node")).distinct() for i in lane_ids]
        of = [d for d in of if not d.isEmpty()]
        if not of and nodes is not None:
            of = [nearest_node(q.where(F.col("query_id") == query), nodes.join(used, "node_id")).select(F.col("node_id").alias("node"))]
        return of

    starts = ends(first, "src", 0)
    if not starts:
        raise LookupError("the start's lane has no edges")
    paths = shortest_paths(spark, edges, starts[0], scratch)
    goals = [r.lane_id for r in sorted(snapped, key=lambda r: r["rank"]) if r.query_id == 1]
    for goal_nodes in ends(goals, "dst", 1):
        best = paths.join(goal_nodes, "node").orderBy("dist", "node").first()
        if best is None:
            continue
        way = path_to(spark, paths, best.node)
        steps = path_edges(spark.createDataFrame(list(enumerate(way)), "step int, node long"), edges)
        return steps if attributes is None else steps.join(attributes, "lane_id", "left")
    raise LookupError("no goal lane can be reached")


def stitched(steps: DataFrame, lanes: DataFrame, first_cut: float = 0.0, last_cut: float = 1.0) -> DataFrame:
    """One row ``points``: the route's line; lanes driven backwards turned, the first and last cut at a fraction, equal neighbours once.

    steps: step, lane_id, backward (boolean).
    """
    from wayloom.functions.polyline import clean, cut

    top = steps.agg(F.max("step").alias("m"))
    d = steps.join(lanes.select(F.col("line_id").alias("lane_id"), "points"), "lane_id").join(F.broadcast(top))  # one row
    line = F.when(F.col("backward"), F.reverse("points")).otherwise(F.col("points"))
    d = d.withColumn("_l", line).withColumn("_l", cut(F.col("_l"), F.when(F.col("step") == 0, F.lit(first_cut)).otherwise(0.0), F.when(F.col("step") == F.col("m"), F.lit(last_cut)).otherwise(1.0)))
    rows = d.agg(F.array_sort(F.collect_list(F.struct("step", F.col("_l").alias("l")))).alias("z"))
    return rows.select(clean(F.flatten(F.transform("z", lambda r: r["l"]))).alias("points"))
