"""Order-dependent rules over connection points against plain loops, on whole tables of the smallest scale."""

import itertools
import math
import os

import pytest

from wayloom.plans import catalogue
from wayloom.sources import fixtures

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def rows(spark):
    return [r.asDict() for r in fixtures.lane_ends(spark, SF).collect()]


def groups(rows, *keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out.values()


def angle(r):
    return math.degrees(math.atan2(r["y"] - r["ny"], r["x"] - r["nx"])) % 360


def apart(a, b):
    return min((a - b) % 360, (b - a) % 360)


def ids(df):
    return sorted(r.cp_id for r in df.collect())


def plain(group):
    """No two points in one direction, none on the line through two others: order and hull don't hang on rounding."""
    turns = sorted(angle(r) for r in group)
    if any(b - a < 1e-6 for a, b in zip(turns, turns[1:])) or any(r["d_node"] == 0 for r in group):
        return False
    widths = [apart(a, b) for a, b in itertools.combinations(turns, 2)]
    if any(min(abs(w - v) for v in (25, 90, 120, 180)) < 1e-6 for w in widths):
        return False
    return all(abs((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])) > 1e-6 for a, b, c in itertools.combinations(group, 3))


def cull(group):
    ring = sorted(group, key=lambda r: (angle(r), r["cp_id"]))
    if len(ring) <= 2:
        return ring
    gone = set()
    for i, a in enumerate(ring):
        for b in ring[i + 1 :]:
            if a["cp_id"] in gone or b["cp_id"] in gone:
                continue
            width = angle(b) - angle(a)
            first, width = (angle(a), width) if width <= 180 else (angle(b), 360 - width)
            if not 25 <= width <= 120:
                continue
            for c in ring:
                if c is not a and c is not b and 0 < (angle(c) - first) % 360 < width and c["d_node"] >= max(a["d_node"], b["d_node"]) + 0.05:
                    gone.add(c["cp_id"])
    return [r for r in ring if r["cp_id"] not in gone]


def test_sector_cull(spark, rows):
    ok = [r for g in groups(rows, "node_id") if plain(g) for r in g]
    want = sorted(r["cp_id"] for g in groups(ok, "node_id") for r in cull(g))
    own = {r["cp_id"] for r in ok}
    assert [i for i in ids(catalogue.sector_cull(spark, SF)) if i in own] == want and len(ok) - len(want) > 300
    rows = ok
    lanes = [r | {"lane": r["lane_no"] if r["lane_no"] is not None else ("none", r["cp_id"])} for r in rows]
    want = sorted(r["cp_id"] for g in groups(lanes, "node_id", "link_id", "lane") for r in cull(g))
    assert [i for i in ids(catalogue.sector_cull_by_lane(spark, SF)) if i in own] == want and len(want) < len(rows)


def test_farther_connected_points(spark, rows):
    want = []
    for g in groups(rows, "node_id", "link_id", "link_end"):
        kept = []
        for p in sorted(g, key=lambda r: (r["d_node"], r["cp_id"])):
            for q in kept:
                dot = (p["x"] - p["nx"]) * (q["x"] - q["nx"]) + (p["y"] - p["ny"]) * (q["y"] - q["ny"])
                if set(p["edges"]) & set(q["edges"]) and dot >= 1e-9 * p["d_node"] * q["d_node"] and p["d_node"] >= q["d_node"] + 0.05:
                    break
                if set(p["edges"]) & set(q["edges"]) and abs(dot) < 1e-9 and p["d_node"] >= q["d_node"] + 0.05:
                    break  # square on: not more than 90 degrees apart
            else:
                kept.append(p)
        want += [p["cp_id"] for p in kept if any(set(p["edges"]) & set(q["edges"]) for q in kept if q is not p)]
    got = ids(catalogue.farther_connected_prune(spark, SF))
    square = {p["cp_id"] for g in groups(rows, "node_id", "link_id", "link_end") for p, q in itertools.permutations(g, 2)
              if abs((p["x"] - p["nx"]) * (q["x"] - q["nx"]) + (p["y"] - p["ny"]) * (q["y"] - q["ny"])) < 1e-9}
    assert set(got) ^ set(want) <= square and len(want) > 300  # only points exactly at the margin may differ, by rounding


def on_hull(group):
    """Ids of the corners of the hull: no line through two others leaves the point on it or inside; of equal points the first."""
    out, seen = set(), {}
    for r in sorted(group, key=lambda r: r["cp_id"]):
        seen.setdefault((r["x"], r["y"]), r["cp_id"])
    pts = sorted(seen)
    if len(pts) <= 2:
        return {seen[p] for p in pts}
    for p in pts:
        turns = sorted(math.atan2(q[1] - p[1], q[0] - p[0]) for q in pts if q != p)
        gaps = [b - a for a, b in zip(turns, turns[1:])] + [turns[0] + 2 * math.pi - turns[-1]]
        if max(gaps) > math.pi + 1e-9:
            out.add(seen[p])
    return out


def test_interior_points(spark, rows):
    want_linked, want_over = [], []
    rows = [r for g in groups(rows, "node_id", "link_id") if plain(g) for r in g]
    own = {r["cp_id"] for r in rows}
    for g in groups(rows, "node_id", "link_id"):
        g = sorted(g, key=lambda r: r["cp_id"])
        hull = on_hull(g)
        inner = [r for r in g if r["cp_id"] not in hull]
        for r in g:
            others = set().union(*(set(q["edges"]) for q in g if q is not r)) if len(g) > 1 else set()
            if len(g) <= 1 or not inner or r["cp_id"] not in hull or set(r["edges"]) & others:
                want_linked.append(r["cp_id"])
            if len(g) <= 2 or not inner or r["cp_id"] not in hull:
                want_over.append(r["cp_id"])
            elif any(set(r["edges"]) & set(q["edges"]) for q in inner):
                near = min(inner, key=lambda q: (round(apart(angle(r), angle(q)), 9), q["cp_id"]))
                if not (apart(angle(r), angle(near)) <= 25 and r["d_node"] >= near["d_node"] + 0.05):
                    want_over.append(r["cp_id"])
    ours = lambda q: [i for i in ids(q(spark, SF)) if i in own]
    assert ours(catalogue.interior_linked_only) == sorted(want_linked) and len(want_linked) < len(rows)
    assert ours(catalogue.interior_over_hull) == sorted(want_over) and len(want_over) < len(want_linked)


def test_seed_nodes(spark, rows):
    want = {}
    for g in groups([r for r in rows if r["d_node"] > 0], "node_id"):
        if len(g) < 3:
            continue
        clusters = []
        for a in sorted(angle(r) for r in g):
            if clusters and apart(a, sum(clusters[-1]) / len(clusters[-1])) <= 15:
                clusters[-1].append(a)
            else:
                clusters.append([a])
        legs = [sum(c) / len(c) for c in clusters]  # a leg nearest the opposite direction never lies near the leg itself here
        ring = sorted(legs)
        if len(legs) >= 3 and all(b - a >= 30 for a, b in zip(ring, [*ring[1:], ring[0] + 360])):
            want[g[0]["node_id"]] = (len(g), len(legs))
    got = {r.node_id: (r.n_conn, r.n_legs) for r in catalogue.angular_seed_nodes(spark, SF).collect()}
    assert got == want and len(want) > 100


def turns(ring):
    out = []
    for i, (x, y) in enumerate(ring):
        (ax, ay), (bx, by) = ring[i - 1], ring[(i + 1) % len(ring)]
        a, b = math.atan2(ay - y, ax - x), math.atan2(by - y, bx - x)
        out.append(apart(math.degrees(a), math.degrees(b)))
    return out


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


@pytest.mark.parametrize("n", [8, 6])
def test_junction_shapes(spark, n):
    seeds, points, edges = (d.collect() for d in fixtures.rings(spark, SF, n))
    place = {p.cp_id: (p.x, p.y) for p in points}
    edge = {frozenset((e.a, e.b)): e.edge_id for e in edges}
    radius, low, most, least, factor = (28, 100, 170, 15, 3.5) if n == 8 else (26, 38, 172, 12, 3.0)
    want = {}
    for s in seeds:
        ring = [s.node_id * 10 + i for i in range(n)]
        xy = [place[c] for c in ring]
        if any(math.dist(p, (s.sx, s.sy)) > radius for p in xy):
            continue
        convex = all((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) > 0 for a, b, c in zip(xy, xy[1:] + xy[:1], xy[2:] + xy[:2]))
        sides = [frozenset((a, b)) for a, b in zip(ring, ring[1:] + ring[:1])]
        if n == 8 and not convex or n == 6 and not all(k in edge for k in sides):
            continue
        if low <= min(turns(xy)) and max(turns(xy)) <= high(most) and least <= shoelace(xy) <= factor * math.pi * radius**2:
            want[s.node_id] = (set(ring), round(shoelace(xy), 6), [edge.get(k, -1) for k in sides].count(-1))
    got = {}
    for r in (catalogue.x4_finder if n == 8 else catalogue.t3_finder)(spark, SF).collect():
        got[r.node_id] = ({int(c) for c in r.cp_ids.split(",")}, r.area, r.perimeter.split(",").count("-1"))
    assert {k: v[:2] for k, v in got.items()} == {k: (v[0], pytest.approx(v[1], abs=1e-5)) for k, v in want.items()}
    assert len(got) > 30 and (n == 8 or all(v[2] == 0 for v in got.values()))


def high(x):
    return x


def test_three_legs_within_four_are_left_out(spark):
    from wayloom.operators.points import three_legs

    seeds = spark.createDataFrame([(1, 0.0, 0.0)], "node_id long, sx double, sy double")
    at = [(k, 10 * math.cos(math.radians(60 * k)), 10 * math.sin(math.radians(60 * k))) for k in range(6)]
    pts = spark.createDataFrame(at, "cp_id long, x double, y double")
    edges = spark.createDataFrame([(k, k, (k + 1) % 6) for k in range(6)], "edge_id long, a long, b long")
    found = three_legs(seeds, pts, edges).collect()
    assert len(found) == 1 and found[0].cp_ids == [0, 1, 2, 3, 4, 5] and found[0].perimeter == [0, 1, 2, 3, 4, 5]
    four = spark.createDataFrame([([0, 1, 2, 3, 4, 5, 6, 7], 1.0, 1.0)], "cp_ids array<long>, cx double, cy double")
    assert three_legs(seeds, pts, edges, four=four).count() == 0
    assert three_legs(seeds, pts, edges, four=four.selectExpr("cp_ids", "cx + 100 as cx", "cy")).count() == 1
    assert three_legs(seeds, pts, edges.where("edge_id <> 2")).count() == 0


def test_nearest_road_node_rule(spark):
    from wayloom.operators.points import of_nearest_node

    rows = spark.createDataFrame([(1, 10, 0.0, 0.0, 5.0), (1, 11, 0.0, 0.0, 5.03), (2, 10, 9.0, 0.0, 4.0), (2, 11, 9.0, 0.0, 14.03)], "cp_id long, node_id long, x double, y double, d_node double")
    nodes = spark.createDataFrame([(10, 5.0, 0.0), (11, -5.03, 0.0)], "node_id long, nx double, ny double")
    assert sorted((r.cp_id, r.node_id) for r in of_nearest_node(rows, nodes).collect()) == [(1, 10), (1, 11), (2, 10)]


RULES = ["farther_connected_prune", "interior_linked_only", "interior_over_hull", "sector_cull", "sector_cull_by_lane", "angular_seed_nodes", "x4_finder", "t3_finder"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RULES)
def test_rules_run_in_batches_of_groups(spark, name):
    """No Python call for each group, and the same rows wherever Arrow's batches end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = lambda: sorted(map(tuple, catalogue.queries()[name](spark, SF).collect()))
    assert "FlatMapGroups" not in plan(catalogue.queries()[name](spark, SF))
    want = rows()
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "3")
        assert rows() == want and want
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("name", ["x4_finder", "t3_finder"])
def test_repeated_points_are_not_broadcast(spark, name):
    """Spark guesses the points at the size of the part table's keys, however many are made of them."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1g")
        assert "Broadcast" not in plan(catalogue.queries()[name](spark, SF))
    finally:
        spark.conf.set(key, before)


def test_rules_with_nulls_and_text_edges(spark):
    """Null edges, points alone, equal places, and a group of more rows than a batch."""
    from wayloom.operators import points

    kind = "cp_id long, node_id long, link_id long, link_end string, x double, y double, nx double, ny double, d_node double, edges array<string>"
    rows = [(1, 1, 0, "start", 1.0, 0.0, 0.0, 0.0, 1.0, ["a"]), (2, 1, 0, "start", 2.0, 0.0, 0.0, 0.0, 2.0, ["a", None]), (3, 1, 0, "start", -3.0, 0.0, 0.0, 0.0, 3.0, ["a"]), (4, 1, 0, "start", 0.0, 4.0, 0.0, 0.0, 4.0, None),
            (5, 1, 0, "end", 1.0, 1.0, 0.0, 0.0, 1.4, ["a"]), (6, 2, 0, "end", 1.0, 1.0, 0.0, 0.0, 1.4, [])]
    df = spark.createDataFrame(rows, kind)
    assert ids(points.drop_farther_connected(df)) == [1, 3]  # 2 is behind 1; 4 to 6 share no edge
    assert ids(points.sector_cull(df)) == [1, 2, 3, 4, 5, 6] and ids(points.prefer_interior(df, True)) == [1, 2, 3, 5, 6]
    many = spark.range(30_000).selectExpr("id as cp_id", "1L as node_id", "0L as link_id", "'end' as link_end", "cast(id % 3 as double) x", "cast(id % 2 as double) y", "0D nx", "0D ny", "1D d_node", "array('e') edges")
    assert points.prefer_interior(many, True).count() == 30_000


def merged_by_loops(angles, merge=15, opposite=15):
    clusters = []
    for a in sorted(v % 360 for v in angles):
        if clusters and apart(a, sum(clusters[-1]) / len(clusters[-1])) <= merge:
            clusters[-1].append(a)
        else:
            clusters.append([a])
    means, legs, gone = [sum(c) / len(c) % 360 for c in clusters], [], set()
    for i, c in enumerate(means):
        if i not in gone:
            gone.add(i)
            legs.append(c)
            j = min(range(len(means)), key=lambda k: apart(means[k], c + 180))
            if j not in gone and apart(means[j], c) <= opposite:
                gone.add(j)
    return legs


def test_legs_of_many_sets_at_once():
    """A set of directions a row, the same legs as one set after the other; 0 and 350 are one leg by way of the opposite direction."""
    import random

    import numpy as np

    from wayloom.operators.points import cluster_angles, leg_clusters

    r = random.Random(8)
    for n in (1, 2, 3, 5, 9, 40):
        sets = [[r.choice([r.uniform(-400, 400), math.degrees(math.atan2(r.randint(-9, 9), r.randint(-9, 9))), 5.0 * r.randint(66, 75)]) for _ in range(n)] for _ in range(300)] + [[(350.0, 0.0)[k % 2] for k in range(n)]]
        means = cluster_angles(np.array(sets))
        legs = leg_clusters(means)
        assert [m[k].tolist() for m, k in zip(means, legs)] == [pytest.approx(merged_by_loops(s), abs=1e-9) for s in sets]
    assert leg_clusters(cluster_angles(np.zeros((0, 3)))).shape[0] == 0


def test_seed_nodes_deal_rows_out_once(spark):
    """Lane ends are dealt out by road node before their lines are made one, and not again; odd groups."""
    from wayloom.operators.points import seed_nodes

    assert plan(catalogue.angular_seed_nodes(spark, SF)).count("Exchange hashpartitioning") == 1
    rows = [(1, a) for a in (0.0, 90.0, 180.0)] + [(2, a) for a in (0.0, 90.0)] + [(3, a) for a in (0.0, 90.0, 180.0, None)] + [(4, a) for a in (0.0, 90.0, 119.0)] + [(None, a) for a in (10.0, 20.0, 120.0, 240.0)]
    df = spark.createDataFrame(rows, "node_id long, angle double")
    assert sorted(map(tuple, seed_nodes(df).collect()), key=str) == [(1, 3, 3, [0.0, 90.0, 180.0]), (None, 4, 3, [15.0, 120.0, 240.0])]
    assert seed_nodes(df.limit(0)).count() == 0
