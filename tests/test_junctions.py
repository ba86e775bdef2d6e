"""Hand fixtures of the junction rules, their traps, and metamorphic tests."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayloom.operators import dual, junctions
from wayloom.operators.components import connected_components
from wayloom.operators.junctions import Limits, _roots
from wayloom.plans.scratch import Scratch
from wayloom.sources import synthetic

P, S, O = 1, 2, 0


def links(spark, rows):
    return spark.createDataFrame(rows, "link_id long, u long, v long, link_type int")


def points(spark, rows):
    return spark.createDataFrame(rows, "link_id long, x double, y double")


def found(spark, rows, pts=(), limits=Limits()):
    d = junctions.detect(spark, links(spark, rows), points(spark, list(pts)), limits)
    return [(r.junction_id, r.seed_link_id, r.secondary_ids, r.primary_ids) for r in d.junctions.orderBy("junction_id").collect()]


def path(first, kinds, node=None):
    node = first * 100 if node is None else node
    return [(first + k, node + k, node + k + 1, kind) for k, kind in enumerate(kinds)]


def test_two_ramps_between_two_mains(spark):
    assert found(spark, path(1, [P, S, S, P])) == [(1, 2, [2, 3], [1, 4])]


@pytest.mark.parametrize("kinds", [[P, S, P], [P, S, S], [S, O, S]])
def test_too_small(spark, kinds):
    assert found(spark, path(1, kinds)) == []


def test_self_loop_and_parallel_links(spark):
    e = dual.dual_edges(links(spark, [(1, 5, 5, S), (2, 5, 6, S), (3, 5, 6, P)]))
    assert sorted((r.src, r.dst) for r in e.collect()) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]


def test_unclassified_links_are_no_bridge(spark):
    rows = path(1, [S, O, S])
    assert dual.dual_edges(links(spark, rows)).count() == 0


def test_index_order_is_that_of_text(spark):
    rows = [(9, 1, 2, S), (10, 3, 4, S), (100, 5, 6, S)]
    got = {r.link_id: r.idx for r in dual.dense_index(links(spark, rows), Scratch(spark, "t")).collect()}
    assert got == {10: 0, 100: 1, 9: 2}


def test_roots_follow_the_order_of_pairs():
    edges = pd.DataFrame({"group": [0, 0], "i": [0, 2], "k": [3, 3]})
    assert _roots(edges).root.tolist() == [2]


def candidate(first, x, shared=None):
    """Two ramps between two mains; ``shared`` makes the second main a common one at node 5000."""
    rows = path(first, [P, S, S] + ([] if shared else [P]))
    if shared:
        rows[2] = (rows[2][0], rows[2][1], shared, S)
    return rows, [(first + 1, x, 0.0), (first + 2, x, 0.0)]


def merged(spark, *parts, extra=(), limits=Limits()):
    rows, pts = list(extra), []
    for r, p in parts:
        rows += r
        pts += p
    return found(spark, rows, pts, limits)


def test_shared_primary_needs_near_points(spark):
    main = [(900, 5000, 5001, P)]
    # node 5000 joins the ramps of both, so they touch the shared main from its two ends
    far = [candidate(10, 0.0, 5000), candidate(20, 400.0, 5001)]
    assert len(merged(spark, *far, extra=main)) == 2
    a, b = candidate(10, 0.0, 5000), candidate(20, 800.0, 5001)
    a[1].append((11, 425.0, 0.0))
    b[1].append((21, 475.0, 0.0))
    assert len(merged(spark, a, b, extra=main)) == 1  # 50 m exactly; centroids are farther
    b[1][-1] = (21, 485.0, 0.0)
    assert len(merged(spark, a, b, extra=main)) == 2
    assert len(merged(spark, a, b, extra=main, limits=Limits(local_distance=None))) == 1


def test_centroids_within_300_metres_merge_alone(spark):
    assert len(merged(spark, candidate(10, 0.0), candidate(20, 300.0))) == 1
    assert len(merged(spark, candidate(10, 0.0), candidate(20, 300.001))) == 2


def test_chains_merge_into_one_group(spark):
    got = merged(spark, candidate(10, 0.0), candidate(20, 250.0), candidate(30, 500.0))
    assert len(got) == 1 and got[0][1] == 11 and got[0][2] == [11, 12, 21, 22, 31, 32]


def test_candidates_without_points_do_not_merge(spark):
    a, b = candidate(10, 0.0), candidate(20, 0.0)
    assert len(merged(spark, (a[0], []), (b[0], [(21, float("nan"), 0.0), (22, None, 1.0)]))) == 2


def test_rejected_components_never_merge(spark):
    got = merged(spark, candidate(10, 0.0), (path(40, [P, S, P]), [(41, 0.0, 0.0)]))
    assert len(got) == 1 and got[0][2] == [11, 12]


def test_hub_finishes(spark):
    rows = [(k, 7, 1000 + k, S) for k in range(1000)]
    assert dual.dual_edges(links(spark, rows)).count() == 999_000


def test_long_chain_is_one_component(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(500)], "src long, dst long")
    got = connected_components(spark, e).collect()
    assert len(got) == 501 and {r.component for r in got} == {0}


def test_components_match_union_find_for_any_order(spark):
    r = random.Random(3)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for p in pairs for x in p}
    for _ in range(2):
        r.shuffle(pairs)
        got = {x.id: x.component for x in connected_components(spark, spark.createDataFrame([*pairs, (None, 1)], "src long, dst long")).collect()}
        assert got == want
    assert connected_components(spark, spark.createDataFrame([], "src long, dst long")).count() == 0


def test_dual_graph_is_symmetric(spark):
    r = random.Random(4)
    e = dual.dual_edges(links(spark, [(k, r.randrange(40), r.randrange(40), r.randrange(3)) for k in range(120)]))
    pairs = {(x.src, x.dst) for x in e.collect()}
    assert pairs == {(b, a) for a, b in pairs}


def test_replicas_multiply_junctions(spark):
    parts = [candidate(10, 0.0), candidate(20, 250.0), candidate(30, 900.0)]
    rows, pts = [x for p in parts for x in p[0]], [x for p in parts for x in p[1]]
    many = synthetic.multiply(links(spark, rows), 12, ("link_id", "u", "v"), (), ()).drop("repeat")
    far = synthetic.multiply(points(spark, pts), 12, ("link_id",), ("x",), ("y",)).drop("repeat")
    assert junctions.detect(spark, many, far).junctions.count() == 12 * len(found(spark, rows, pts)) == 24


def test_hops_reach_through_primaries(spark):
    rows = path(1, [P, S, S, P, P, P])
    ls = links(spark, rows)
    comp = junctions.secondary_components(spark, ls, Scratch(spark, "t"))
    bound = junctions.component_boundary(ls, comp)
    for hops, want in ((0, {1, 4}), (1, {1, 4, 5}), (2, {1, 4, 5, 6})):
        assert {r.primary_id for r in junctions.primaries_within_hops(bound, ls, hops).collect()} == want


def test_roles(spark):
    d = junctions.detect(spark, links(spark, path(1, [P, S, S, P])), points(spark, []))
    got = [(r.link_id, r.role, r.u, r.v) for r in junctions.link_roles(d.junctions).orderBy("link_id").collect()]
    assert got == [(1, "main", 2, 3), (2, "ramp", 4, 5), (3, "ramp", 6, 7), (4, "main", 8, 9)]


def test_range_join_is_the_theta_join(spark):
    from wayloom.operators.spatial import k_nearest, range_join

    r = random.Random(6)
    a = [(k, r.uniform(-50, 50), r.uniform(-50, 50)) for k in range(150)] + [(999, float("nan"), 0.0), (998, float("inf"), 0.0)]
    b = [(k, float(r.randrange(-50, 50)), float(r.randrange(-50, 50))) for k in range(150)]
    da, db = spark.createDataFrame(a, "a long, x double, y double"), spark.createDataFrame(b, "b long, x2 double, y2 double")
    got = {(q.a, q.b) for q in range_join(da, db, 7.0).collect()}
    dist = lambda p, q: ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5
    assert got == {(p[0], q[0]) for p in a for q in b if dist(p, q) <= 7.0}
    qs = db.select(F.col("b").alias("q_id"), F.col("x2").alias("qx"), F.col("y2").alias("qy")).limit(30)
    ps = da.where("a < 900").select(F.col("a").alias("p_id"), "x", "y")
    near = {(n.q_id, n.rank): n.p_id for n in k_nearest(qs, ps, 3, 2.0).collect()}
    byid = {q[0]: q for q in b}
    for q in {k[0] for k in near}:
        want = sorted((dist(p, byid[q]), p[0]) for p in a if p[0] < 900)[:3]
        assert [near[q, k] for k in (1, 2, 3)] == [w[1] for w in want]


def test_document_in_parts_is_the_document(spark, monkeypatch):
    """Joined, the parts are the JSON object; their rows are its rows, wherever parts end."""
    import json

    from wayloom.sources import documents

    rows = [(i, i * 10, 1 + i % 2, [k for k in range(7) if (i + k) % 3 == 0 and k != i], [{"x": float(k), "y": i / 2} for k in range(i % 3)]) for i in range(7)]
    kind = "idx int, link_id long, link_type int, neighbours array<int>, points array<struct<x:double,y:double>>"
    df = spark.createDataFrame(rows, kind)
    around = spark.createDataFrame([(r[1] + 1, r[4]) for r in rows], "link_id long, points array<struct<x:double,y:double>>")
    for items, made, back in ((16_384, df, around), (3, df, around), (1, df, None), (3, df.limit(0), None)):
        monkeypatch.setattr(documents, "PART_ITEMS", items)
        parts = documents.graph_document_parts(made, 'c"1', back).cache()
        text = "".join(r.value for r in sorted(parts.collect(), key=lambda r: (r.field, r.part)))
        whole = json.loads(documents.graph_document(made, 'c"1', back).first().value)
        assert json.loads(text) == whole and list(json.loads(text)) == list(whole)
        got = sorted(documents.graph_rows_of_parts(parts).collect())
        assert [(r.idx, r.link_id, r.link_type, r.neighbours) for r in got] == [(a, b, c, d) for a, b, c, d, _ in rows][: len(whole["link_ids"])]
        assert [r.row_offset for r in got] == whole["row_offsets"][:-1] and [r.point_offset for r in got] == whole["point_offsets"][:-1]
        assert [r.x1 for r in got if r.x1 == r.x1] == [v for v in whole["link_plot_x1"] if v != "NaN"]
        assert [(r.link_id, r.point_offset) for r in sorted(documents.background_rows_of_parts(parts).collect())] == list(zip(whole["background_link_ids"], whole["background_point_offsets"]))
        largest = max(len(r.value) for r in parts.where("field >= 0 and part between 0 and 1000000").collect() or [type("r", (), {"value": ""})])
        assert items > 3 or largest < 60


def test_background_parts_without_the_graph(spark, monkeypatch):
    """The background's parts are those of the whole document, and its query builds neither the graph nor the arrays of its links."""
    from wayloom.plans import catalogue, roads
    from wayloom.sources import documents, fixtures

    kind = "link_id long, points array<struct<x:double,y:double>>"
    around = spark.createDataFrame([(i, [{"x": float(k), "y": i / 2} for k in range(i % 4)]) for i in range(30)], kind)
    links = around.limit(0).selectExpr("0 idx", "link_id", "1 link_type", "array(0) neighbours", "points")
    for items in (16_384, 5, 1):
        monkeypatch.setattr(documents, "PART_ITEMS", items)
        whole = documents.graph_document_parts(links, "c", around).where("part between 0 and 1000000")
        own = documents.background_parts(around, Scratch(spark, "t"))
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, whole.collect())) and own.count() >= 7
    sf = "/root/testdata/sf0.001"
    want = documents.with_points(fixtures.road_links(spark, sf), fixtures.link_points(fixtures.road_links(spark, sf)))
    assert sorted(map(tuple, fixtures.road_lines(spark, sf).collect())) == sorted((r.link_id, r.points) for r in want.collect())
    monkeypatch.setattr(roads, "graph_rows", lambda *_: 1 / 0)
    rows = sorted(catalogue.background_document_rows(spark, sf).collect())
    assert [r.point_offset for r in rows] == [2 * i for i in range(len(rows))] and len(rows) == want.count()


def test_rows_of_a_part_wait_packed(spark):
    """What is gathered to a part is one packed value a row, not the objects of its fields."""
    from wayloom.sources import documents

    made = []

    class Kept(Scratch):
        def cut(self, df, name):
            made.append(df._jdf.queryExecution().optimizedPlan().toString())
            return super().cut(df, name)

    df = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}])], "link_id long, points array<struct<x:double,y:double>>")
    documents.background_parts(df, Kept(spark, "t"))
    assert "collect_list(_row#" in made[-1]
