"""Polylines: arrays of structs (x, y), with higher-order functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_POINTS = 64


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def steps(p: Column) -> Column:
    """Lengths of the segments."""
    n = F.size(p)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.hypot(
        F.get(p, i)["x"] - F.get(p, i - 1)["x"], F.get(p, i)["y"] - F.get(p, i - 1)["y"]))).otherwise(F.array().cast("array<double>"))


def length(p: Column) -> Column:
    return F.aggregate(steps(p), F.lit(0.0), lambda s, d: s + d)


def arclengths(p: Column) -> Column:
    """Length from the start to every point; empty for no points."""
    first = F.when(F.size(p) > 0, F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>"))
    return F.aggregate(steps(p), first, lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)))


def finite_points(p: Column) -> Column:
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.filter(p, lambda q: ok(q["x"]) & ok(q["y"]))


def clean(p: Column) -> Column:
    """Finite points without equal neighbours."""
    def add(acc, q):
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["x"] == q["x"]) & (F.try_element_at(acc, F.lit(-1))["y"] == q["y"])
        return F.when(same, acc).otherwise(F.concat(acc, F.array(q)))
    return F.aggregate(finite_points(p), F.array().cast("array<struct<x:double,y:double>>"), add)


def subsample(p: Column, most: int = MAX_POINTS) -> Column:
    """At most ``most`` points, ends kept, at evenly spaced indices rounded half to even."""
    n = F.size(p)
    pick = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.get(p, F.rint(k * ((n - 1) / F.lit(float(most - 1)))).cast("int")))
    return F.when(n <= most, p).otherwise(pick)


def _mix(a: Column, b: Column, f: Column) -> Column:
    return point(a["x"] + (b["x"] - a["x"]) * f, a["y"] + (b["y"] - a["y"]) * f)


def point_at(p: Column, s: Column) -> Column:
    """Point at arclength s, held within the line."""
    def at(c):
        total = F.element_at(c, -1)
        t = F.least(F.greatest(s.cast("double"), F.lit(0.0)), total)
        i = F.least(F.greatest(F.size(F.filter(c, lambda v: v <= t)), F.lit(1)), F.size(p) - 1)  # 1-based segment
        a, b = F.get(c, i - 1), F.get(c, i)
        return _mix(F.get(p, i - 1), F.get(p, i), F.when(b > a, (t - a) / (b - a)).otherwise(0.0))
    return F.when(F.size(p) >= 2, _let(arclengths(p), at)).otherwise(F.get(p, F.lit(0)))


def direction_at(p: Column, fraction: Column) -> Column:
    """Unit direction of the segment at a fraction of the length."""
    def at(c):
        t = F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)) * F.element_at(c, -1)
        i = F.least(F.greatest(F.size(F.filter(c, lambda v: v <= t)), F.lit(1)), F.size(p) - 1)
        dx, dy = F.get(p, i)["x"] - F.get(p, i - 1)["x"], F.get(p, i)["y"] - F.get(p, i - 1)["y"]
        h = F.hypot(dx, dy)
        return F.when(h > 0, point(dx / h, dy / h)).otherwise(point(F.lit(0.0), F.lit(0.0)))
    return F.when(F.size(p) >= 2, _let(arclengths(p), at))


def cut(p: Column, f0: Column, f1: Column) -> Column:
    """The part between two fractions of the length, in either order."""
    lo, hi = (F.least(F.greatest(g(f0, f1), F.lit(0.0)), F.lit(1.0)) for g in (F.least, F.greatest))

    def part(c):
        total = F.element_at(c, -1)
        inner = F.filter(F.zip_with(p, c, lambda q, s: F.struct(q.alias("q"), s.alias("s"))), lambda z: (z["s"] > lo * total) & (z["s"] < hi * total))
        return F.concat(F.array(point_at(p, lo * total)), F.transform(inner, lambda z: z["q"]), F.array(point_at(p, hi * total)))
    return F.when(F.size(p) >= 2, _let(arclengths(p), part)).otherwise(p)


def clip_to_length(p: Column, metres: float) -> Column:
    """The first vertices within a length of the start, two at least."""
    return _let(arclengths(p), lambda c: F.slice(p, 1, F.greatest(F.size(F.filter(c, lambda v: v <= metres)), F.lit(2))))


def reverse_lane(lane: Column) -> Column:
    """Centreline reversed; the boundaries change sides but keep their own direction."""
    return F.struct(F.reverse(lane["centre"]).alias("centre"), lane["right"].alias("left"), lane["left"].alias("right"))


def orient(p: Column, start: Column, end: Column) -> Column:
    """Reversed if that brings the ends nearer to two nodes; as it is on a tie."""
    d = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    first, last = F.get(p, F.lit(0)), F.element_at(p, -1)
    return F.when(F.size(p) < 2, p).when(d(first, start) + d(last, end) <= d(last, start) + d(first, end), p).otherwise(F.reverse(p))


def signed_area(p: Column) -> Column:
    """Shoelace sum, the ring closed; positive counter-clockwise."""
    n = F.size(p)
    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda s, i: s + F.get(p, i)["x"] * F.get(p, (i + 1) % n)["y"] - F.get(p, (i + 1) % n)["x"] * F.get(p, i)["y"]) / 2).otherwise(0.0)


def heading(a: Column, b: Column) -> Column:
    """Degrees counter-clockwise from east, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])), F.lit(360.0))


def wrap_degrees(d: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(d + 180, F.lit(360.0)) - 180


def undirected_difference(a: Column, b: Column) -> Column:
    """Between two lines without direction: 0 to 90 degrees."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def angular_span(degrees: Column) -> Column:
    """360 less the largest gap between neighbouring directions; 0 for fewer than two."""
    s = F.array_sort(F.transform(degrees, lambda d: F.pmod(d, F.lit(360.0))))

    def span(v):
        n = F.size(v)
        gaps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < n - 1, F.get(v, i + 1) - F.get(v, i)).otherwise(F.get(v, F.lit(0)) + 360 - F.element_at(v, -1)))
        return F.lit(360.0) - F.array_max(gaps)

    return F.when(F.size(degrees) >= 2, _let(s, span)).otherwise(0.0)


def segments_cross(a: Column, b: Column, c: Column, d: Column, touching: bool = True) -> Column:
    """Whether segments ab and cd meet; without ``touching`` only where both cross inside."""
    turn = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    t1, t2, t3, t4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    strict = (t1 * t2 < 0) & (t3 * t4 < 0)
    if not touching:
        return strict
    on = lambda p, q, r: r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
    return strict | ((t1 == 0) & on(a, b, c)) | ((t2 == 0) & on(a, b, d)) | ((t3 == 0) & on(c, d, a)) | ((t4 == 0) & on(c, d, b))


def total_turn(p: Column) -> Column:
    """Sum of absolute heading changes in degrees."""
    n = F.size(p)
    turn = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.abs(wrap_degrees(heading(F.get(p, i), F.get(p, i + 1)) - heading(F.get(p, i - 1), F.get(p, i)))))
    return F.when(n >= 3, F.aggregate(turn, F.lit(0.0), lambda s, t: s + t)).otherwise(0.0)


def ray_meet(ax, ay, adx, ady, bx, by, bdx, bdy) -> tuple[Column, Column, Column]:
    """(t, u, parallel): a + t ad = b + u bd."""
    det = adx * bdy - ady * bdx
    ok = F.abs(det) > 1e-12
    return F.when(ok, ((bx - ax) * bdy - (by - ay) * bdx) / det), F.when(ok, ((bx - ax) * ady - (by - ay) * adx) / det), ~ok


def hull_indices(x, y) -> list[int]:
    """Monotone chain: indices of the convex hull, counter-clockwise from the least point, without points on its edges."""
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i], i))
    order = [i for k, i in enumerate(order) if not k or (x[i], y[i]) != (x[order[k - 1]], y[order[k - 1]])]
    if len(order) < 3:
        return order
    turn = lambda o, a, b: (x[a] - x[o]) * (y[b] - y[o]) - (y[a] - y[o]) * (x[b] - x[o])
    halves = []
    for run in (order, order[::-1]):
        chain: list[int] = []
        for i in run:
            while len(chain) > 1 and turn(chain[-2], chain[-1], i) <= 0:
                chain.pop()
            chain.append(i)
        halves += chain[:-1]
    return halves


def convex_hull(points) -> Column:
    """Hull of an array of points (Arrow batches; a chain of turns has no column form)."""

    def hulls(batch: pd.Series) -> pd.Series:
        def one(p):
            if p is None:
                return None
            p = list(p)
            x, y = [q["x"] for q in p], [q["y"] for q in p]
            return [{"x": x[i], "y": y[i]} for i in hull_indices(x, y)]

        return batch.map(one)

    return F.pandas_udf(hulls, "array<struct<x:double,y:double>>")(points)


def net_turn(p: Column) -> Column:
    """Degrees from the first segment's heading to the last one's, turns added up with their sign."""
    n = F.size(p)
    turn = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: wrap_degrees(heading(F.get(p, i), F.get(p, i + 1)) - heading(F.get(p, i - 1), F.get(p, i))))
    return F.when(n >= 3, F.aggregate(turn, F.lit(0.0), lambda s, t: s + t)).otherwise(0.0)


def least_radius(p: Column) -> Column:
    """Least radius of curvature: at each inner point the mean length of its segments over the turn in radians; infinite for straight lines."""
    n, far = F.size(p), F.lit(float("inf"))
    length = lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])

    def radius(i):
        a, b, c = F.get(p, i - 1), F.get(p, i), F.get(p, i + 1)
        turn, mean = F.radians(F.abs(wrap_degrees(heading(b, c) - heading(a, b)))), (length(a, b) + length(b, c)) / 2
        return F.when((turn > 0) & (mean > 0), mean / turn).otherwise(far)

    return F.when(n >= 3, F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), radius))).otherwise(far)


def straightness(p: Column) -> Column:
    """R squared of the straight line fitted to y over x."""
    n = F.size(p)
    mean = lambda k: F.aggregate(p, F.lit(0.0), lambda s, q: s + q[k]) / n

    def fit(m):
        total = lambda j, k: F.aggregate(p, F.lit(0.0), lambda s, q: s + (q[j] - m[j]) * (q[k] - m[k]))
        sums = F.struct(total("x", "x").alias("xx"), total("x", "y").alias("xy"), total("y", "y").alias("yy"))
        return _let(sums, lambda t: 1 - (t["yy"] - F.when(t["xx"] > 0, t["xy"] * t["xy"] / t["xx"]).otherwise(0.0)) / (t["yy"] + 1e-9))

    return F.when(n >= 1, _let(F.struct(mean("x").alias("x"), mean("y").alias("y")), fit))


def _meet(a, b, c, d):
    """The point that segments ab and cd share (the middle of what they share), or None."""
    rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    qx, qy, det = c[0] - a[0], c[1] - a[1], rx * sy - ry * sx
    if abs(det) > 1e-12:
        t, u = (qx * sy - qy * sx) / det, (qx * ry - qy * rx) / det
        return (a[0] + t * rx, a[1] + t * ry) if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= u <= 1 + 1e-12 else None
    size = rx * rx + ry * ry
    if not size or abs(qx * ry - qy * rx) > 1e-9:
        return None
    lo, hi = sorted(((v[0] - a[0]) * rx + (v[1] - a[1]) * ry) / size for v in (c, d))
    lo, hi = max(lo, 0.0), min(hi, 1.0)
    return (a[0] + (lo + hi) / 2 * rx, a[1] + (lo + hi) / 2 * ry) if lo <= hi else None


def _foot(p, a, b):
    """(distance, foot) of a point to a segment."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    t = min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / size)) if size else 0.0
    foot = (a[0] + t * dx, a[1] + t * dy)
    return math.dist(p, foot), foot


def t_meeting(a: list[tuple[float, float]], b: list[tuple[float, float]], reach: float = 400.0, most_apart: float = 200.0) -> tuple:
    """(mode, x, y, end_a, end_b, least distance) of where two lines meet in a T.

    ``main``: the lines meet. Else rays of ``reach`` metres leave each line at the end that is nearer the other: ``ray-ray`` if
    both meet (and the lines are within ``most_apart``), ``A-ray-B`` or ``B-ray-A`` if one meets the other line. Mode null: nowhere.
    """
    pairs = lambda p: list(zip(p, p[1:]))
    for s in pairs(a):
        for t in pairs(b):
            if hit := _meet(*s, *t):
                return "main", *hit, None, None, 0.0
    near = [(*_foot(p, *t), p, True) for p in a for t in pairs(b)] + [(*_foot(p, *s), p, False) for p in b for s in pairs(a)]
    least, foot, corner, of_a = min(near)
    on_a, on_b = (corner, foot) if of_a else (foot, corner)
    end = lambda p, q: "start" if math.dist(p[0], q) <= math.dist(p[-1], q) else "end"
    end_a, end_b = end(a, on_b), end(b, on_a)

    def ray(p, which):
        tip, back = (p[0], p[1]) if which == "start" else (p[-1], p[-2])
        size = math.dist(tip, back) or 1.0
        return tip, (tip[0] + reach * (tip[0] - back[0]) / size, tip[1] + reach * (tip[1] - back[1]) / size)

    ray_a, ray_b = ray(a, end_a), ray(b, end_b)
    tries = ([("ray-ray", ray_a, [ray_b])] if least <= most_apart else []) + [("A-ray-B", ray_a, pairs(b)), ("B-ray-A", ray_b, pairs(a))]
    for mode, line, others in tries:
        for other in others:
            if hit := _meet(*line, *other):
                return mode, *hit, end_a, end_b, least
    return None, None, None, end_a, end_b, least


def t_intersection(a: Column, b: Column) -> Column:
    """Struct(mode, x, y, end_a, end_b, least) of two polylines, as ``t_meeting`` has it; null for lines of fewer than two points."""

    def both(p: pd.Series, q: pd.Series) -> pd.DataFrame:
        line = lambda v: [(w["x"], w["y"]) for w in v]
        ok = lambda v: v is not None and len(v) > 1
        rows = [t_meeting(line(x), line(y)) if ok(x) and ok(y) else (None,) * 6 for x, y in zip(p, q, strict=True)]
        return pd.DataFrame(rows, columns=["mode", "x", "y", "end_a", "end_b", "least"]).astype({c: "float64" for c in ("x", "y", "least")})

    return F.pandas_udf(both, "mode string, x double, y double, end_a string, end_b string, least double")(a, b)
