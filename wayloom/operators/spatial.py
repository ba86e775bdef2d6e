"""Range and nearest-neighbour joins over a grid of cells.

A pair within a radius lies in the same cell or in touching ones when cells are
as wide as the radius, so the join is an equi-join on the cell with one side
repeated into nine, and the exact distance tested after it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.plans.scratch import Scratch


def distance(ax, ay, bx, by) -> Column:
    """Plane distance; the square root is compared with thresholds, not its square."""
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return F.sqrt(dx * dx + dy * dy)


def _cell(c: Column, radius: float) -> Column:
    return F.floor(c / F.lit(float(radius))).cast("long")


def range_join(left: DataFrame, right: DataFrame, radius: float, lx="x", ly="y", rx="x2", ry="y2", extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows of both sides with ``dist`` at most ``radius``; points that aren't finite match nothing.

    ``extra``: further equal columns. Column names of the sides must differ.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    a = left.where(finite(lx) & finite(ly)).withColumn("_cx", _cell(F.col(lx), radius)).withColumn("_cy", _cell(F.col(ly), radius))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = right.where(finite(rx) & finite(ry)).withColumn("_s", F.explode(steps))
    b = b.withColumn("_dx", _cell(F.col(rx), radius) + F.col("_s.i")).withColumn("_dy", _cell(F.col(ry), radius) + F.col("_s.j")).drop("_s")
    on = (F.col("_cx") == F.col("_dx")) & (F.col("_cy") == F.col("_dy"))
    for x, y in extra or []:
        on &= F.col(x) == F.col(y)
    b = b.hint("merge")  # Spark's guess of a side's size leaves out rows that were made of rows, so it would broadcast large ones
    return a.join(b, on).withColumn("dist", distance(lx, ly, rx, ry)).where(F.col("dist") <= radius).drop("_cx", "_cy", "_dx", "_dy")


def _box_distances(size: Column) -> tuple[Column, Column]:
    """(least, most) distance from a query to the points of its cell, a little wider than exact."""
    slack = F.lit(1e-9) * (F.abs("_qx") + F.abs("_qy") + size) + F.lit(1e-9)
    low, most = [], []
    for q, c in (("_qx", "_cx"), ("_qy", "_cy")):
        a, b = F.col(c) * size, (F.col(c) + 1) * size
        low.append(F.greatest(a - F.col(q), F.col(q) - b, F.lit(0.0)))
        most.append(F.greatest(F.abs(F.col(q) - a), F.abs(b - F.col(q))))
    return F.sqrt(low[0] * low[0] + low[1] * low[1]) - slack, F.sqrt(most[0] * most[0] + most[1] * most[1]) + slack


def _near_enough(cells: DataFrame, query_id: str, k: int, size: float) -> DataFrame:
    """The cells (query, _cx, _cy, _n) that can hold one of a query's k nearest points."""
    low, most = _box_distances(F.lit(float(size)))
    cells = cells.withColumn("_low", low).withColumn("_most", most)
    own = Window.partitionBy(query_id)
    cells = cells.withColumn("_until", F.sum("_n").over(own.orderBy("_most", "_cx", "_cy").rowsBetween(Window.unboundedPreceding, 0)))
    cells = cells.withColumn("_bound", F.min(F.when(F.col("_until") >= k, F.col("_most"))).over(own))
    return cells.where(F.col("_bound").isNull() | (F.col("_low") <= F.col("_bound"))).drop("_low", "_most", "_until", "_bound")


def k_nearest(queries: DataFrame, points: DataFrame, k: int, cell: float, query_id="q_id", point_id="p_id", qx="qx", qy="qy", px="x", py="y",
              crowd: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """query_id, point_id, dist, rank: the k nearest points of every query, exactly; ties by point_id.

    The points are counted in a pyramid of cells, from ``cell`` (less where a cell has more than
    ``crowd`` points) up to one for all. Queries go down the pyramid: at each level a query
    keeps the cells that are nearer than the farthest corner of those that surely hold k
    points, so neither empty country nor a city near by makes it look at more than a few
    cells. Points of the last cells are measured. Queries and points that aren't finite match nothing;
    with fewer than k points a query gets all of them. Each level is written, so plans stay short.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    spark = points.sparkSession
    scratch = scratch or Scratch(spark, "nearest")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    ends = points.where(finite(px) & finite(py)).agg(F.min(px).alias("x0"), F.max(px).alias("x1"), F.min(py).alias("y0"), F.max(py).alias("y1")).first()  # one row
    own = queries.where(finite(qx) & finite(qy)).select(query_id, F.col(qx).cast("double").alias("_qx"), F.col(qy).cast("double").alias("_qy"))
    x0, y0 = (0.0, 0.0) if ends.x0 is None else (float(ends.x0), float(ends.y0))
    extent = 0.0 if ends.x0 is None else max(float(ends.x1) - x0, float(ends.y1) - y0)
    size = float(cell)
    while extent / size > 1 << 40:  # cell numbers stay exact
        size *= 2
    own = own.withColumn("_qx", F.col("_qx") - x0).withColumn("_qy", F.col("_qy") - y0)
    moved = points.where(finite(px) & finite(py)).select(F.col(point_id), (F.col(px).cast("double") - x0).alias("_x"), (F.col(py).cast("double") - y0).alias("_y"))
    placed = lambda c: moved.withColumn("_cx", F.floor(F.col("_x") / c).cast("long")).withColumn("_cy", F.floor(F.col("_y") / c).cast("long"))
    for step in range(4):  # smaller cells where the points are dense
        base = scratch.cut(placed(size).groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_n")), "cells")
        most = base.agg(F.max("_n").alias("n")).first().n or 0
        if most <= crowd or step == 3 or extent / size > 1 << 36:
            break
        size /= 2 ** max(1, math.ceil(math.log2(most / crowd) / 2))
    levels, top = [], 0
    while (1 << top) * size <= extent:
        top += 2
    levels = list(range(top, -1, -2))
    up = base.select(F.explode(F.array(*[F.lit(v) for v in levels])).alias("_lv"), "_cx", "_cy", "_n")
    up = up.groupBy("_lv", F.expr("shiftright(_cx, _lv)").alias("_cx"), F.expr("shiftright(_cy, _lv)").alias("_cy")).agg(F.sum("_n").alias("_n"))
    pyramid = scratch.cut(up, "pyramid")
    front = own.join(F.broadcast(pyramid.where(F.col("_lv") == top).drop("_lv")))  # the few cells of the top level
    for level in levels[1:]:
        keep = _near_enough(front, query_id, k, size * (1 << (level + 2))).drop("_n").withColumnsRenamed({"_cx": "_ux", "_cy": "_uy"})
        below = pyramid.where(F.col("_lv") == level).select("_cx", "_cy", "_n", F.shiftright("_cx", 2).alias("_vx"), F.shiftright("_cy", 2).alias("_vy"))
        front = keep.join(below, (F.col("_ux") == F.col("_vx")) & (F.col("_uy") == F.col("_vy"))).select(query_id, "_qx", "_qy", "_cx", "_cy", "_n")
        front = scratch.cut(front, f"front{level}")
    last = _near_enough(front, query_id, k, size).select(query_id, "_qx", "_qy", "_cx", "_cy")
    near = last.join(placed(size), ["_cx", "_cy"]).select(query_id, point_id, distance("_qx", "_qy", "_x", "_y").alias("dist"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy("dist", point_id))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(queries: DataFrame, points: DataFrame, cell: float, **names) -> DataFrame:
    return k_nearest(queries, points, 1, cell, **names).drop("rank")


def segments(polylines: DataFrame, line_id: str = "line_id", points: str = "points") -> DataFrame:
    """line_id, seg_no, ax, ay, bx, by, s0 (length before the segment), total from an array of structs (x, y)."""
    seg = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.struct(
        (i - 1).alias("seg_no"), F.element_at(points, i)["x"].alias("ax"), F.element_at(points, i)["y"].alias("ay"),
        F.element_at(points, i + 1)["x"].alias("bx"), F.element_at(points, i + 1)["y"].alias("by")))
    rows = polylines.where(F.size(points) >= 2).select(line_id, F.explode(seg).alias("s")).select(line_id, "s.*")
    rows = rows.withColumn("_len", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    order = Window.partitionBy(line_id).orderBy("seg_no")
    return (rows.withColumn("s0", F.coalesce(F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("total", F.sum("_len").over(Window.partitionBy(line_id))).withColumnRenamed("_len", "seg_len"))


def project_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """(t in [0, 1], foot x, foot y) of the nearest point of a segment; a segment of no length has t = 0."""
    dx, dy = bx - ax, by - ay
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / l2))).otherwise(F.lit(0.0))
    return t, ax + t * dx, ay + t * dy


def project_points(pairs: DataFrame, query_id: str, line_id: str = "line_id", px: str = "px", py: str = "py") -> DataFrame:
    """query_id, line_id, dist, s, frac, fx, fy from rows of (query, segment): the first nearest segment wins."""
    t, fx, fy = project_on_segment(F.col(px), F.col(py), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    d = pairs.withColumn("_t", t).withColumn("fx", fx).withColumn("fy", fy)
    d = d.withColumn("dist", F.hypot(F.col(px) - F.col("fx"), F.col(py) - F.col("fy"))).withColumn("s", F.col("s0") + F.col("_t") * F.col("seg_len"))
    best = F.min(F.struct("dist", "seg_no", "s", "fx", "fy", "total"))
    return d.groupBy(query_id, line_id).agg(best.alias("b")).select(query_id, line_id, "b.dist", "b.s", F.when(F.col("b.total") > 0, F.col("b.s") / F.col("b.total")).otherwise(0.0).alias("frac"), "b.fx", "b.fy")
