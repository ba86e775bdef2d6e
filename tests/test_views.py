import math

import pytest
from pyspark.sql import functions as F

from wayloom.functions import polyline
from wayloom.operators import graphs, pseudo, views
from wayloom.sources import aliases, tiles

LINE = "array<struct<x:double,y:double>>"


def test_columns_by_alias(spark):
    df = spark.createDataFrame([(1, 2, None, 4, 5), (7, None, None, None, 9)], "LinkId long, U long, start_node_id long, v long, z long")
    assert aliases.link_id_column(df) == "LinkId" and aliases.endpoint_columns(df) == ("U", "v")
    assert [tuple(r) for r in aliases.link_ends_table(df).collect()] == [(1, 2, 4)]
    with pytest.raises(LookupError):
        aliases.endpoint_columns(df.select("z"))


def test_view_and_boxes(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 5.0, 5.0), (4, None, 1.0), (5, float("nan"), 1.0)], "node_id long, lat double, lon double")
    links = spark.createDataFrame([(10, 1, 3), (11, 3, 3), (12, 3, 2), (13, 4, 5), (14, None, 2)], "link_id long, u long, v long")
    own, ends = views.view(links, nodes, (1.0, 0.0, 0.0, 1.0))
    assert sorted(r.link_id for r in own.collect()) == [10, 12, 14] and sorted(r.node_id for r in ends.collect()) == [1, 2, 3]
    assert views.view(links, nodes, None)[0].count() == 5
    box = views.enu_box(spark, (52.0, 13.0, 52.01, 13.02), 52.0, 13.0).first()
    assert abs(box.x0) < 1 and 1300 < box.x1 < 1400 and abs(box.y0) < 1 and 1100 < box.y1 < 1120


def test_line_of_a_link(spark):
    nodes = spark.createDataFrame([(1, 52.0, 13.0), (2, 52.001, 13.0)], "node_id long, lat double, lon double")
    links = spark.createDataFrame([(10, 1, 2, [52.0, 52.0005, 52.001], [13.0, 13.0, 13.0]), (11, 1, 2, [52.0], [13.0]), (12, 1, 9, [52.0], [13.0, 13.1]), (13, 9, 9, [52.0, 52.001], [13.0, 13.0])],
                                  "link_id long, u long, v long, lat array<double>, lon array<double>")
    got = {r.link_id: r for r in views.link_lines(links, nodes, 52.0, 13.0).collect()}
    assert [len(got[k].points) for k in (10, 11, 12, 13)] == [3, 2, 0, 2] and got[12]["first"] is None
    assert got[11]["last"].y == pytest.approx(got[10].points[-1].y) and got[13]["last"].y == pytest.approx(111.25, abs=0.3)


def test_turns_radius_and_straightness(spark):
    circle = [(50 * math.cos(math.radians(3 * k)), 50 * math.sin(math.radians(3 * k))) for k in range(31)]
    rows = [(1, circle), (2, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]), (3, [(0.0, 0.0), (0.0, 5.0)]), (4, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (20.0, 10.0)])]
    df = spark.createDataFrame(rows, f"id long, p {LINE}")
    got = {r.id: r for r in df.select("id", polyline.net_turn(F.col("p")).alias("t"), polyline.least_radius(F.col("p")).alias("r"), polyline.straightness(F.col("p")).alias("s")).collect()}
    assert got[1].t == pytest.approx(87, abs=0.01) and got[1].r == pytest.approx(50, rel=0.01) and got[1].s < 0.95
    assert got[2].t == 0 and got[2].r == math.inf and got[2].s == pytest.approx(1) and got[3].r == math.inf and got[3].s == pytest.approx(0, abs=1e-9)
    assert got[4].t == pytest.approx(0) and got[4].r == pytest.approx(10 / (math.pi / 2))


def test_lines_that_meet_in_a_t(spark):
    a = [(0.0, 0.0), (10.0, 0.0)]
    cases = [([(5.0, -5.0), (5.0, 5.0)], ("main", 5.0, 0.0)), ([(5.0, 4.0), (5.0, 9.0)], ("B-ray-A", 5.0, 0.0)), ([(20.0, -5.0), (20.0, 5.0)], ("A-ray-B", 20.0, 0.0)),
             ([(20.0, 5.0), (20.0, 9.0)], ("ray-ray", 20.0, 0.0)), ([(0.0, 3.0), (10.0, 3.0)], (None, None, None)), ([(1000.0, 5.0), (1000.0, 9.0)], (None, None, None)), ([(4.0, 0.0), (8.0, 0.0)], ("main", 6.0, 0.0))]
    df = spark.createDataFrame([(k, a, b) for k, (b, _) in enumerate(cases)] + [(99, a, [(1.0, 1.0)])], f"id long, a {LINE}, b {LINE}")
    got = {r.id: r.t for r in df.select("id", polyline.t_intersection(F.col("a"), F.col("b")).alias("t")).collect()}
    for k, (_, want) in enumerate(cases):
        assert (got[k].mode, got[k].x, got[k].y) == (want if want[0] is None else (want[0], pytest.approx(want[1]), pytest.approx(want[2], abs=1e-9)))
    assert (got[3].end_a, got[3].end_b) == ("end", "start") and got[1].least == 4.0 and got[99].mode is None


def test_nested_attributes_have_dotted_keys(spark):
    rows = spark.createDataFrame([(1, "a", '{"b": {"c": true, "d": [1, 2]}, "e": "x", "f": null}'), (1, "g", "5"), (2, "h", "[1]")], "link_id long, key string, raw string")
    assert sorted((r.link_id, r.key, r.raw) for r in tiles.dotted(rows).collect()) == [(1, "a.b.c", "true"), (1, "a.b.d", "[1, 2]"), (1, "a.e", "x"), (1, "g", "5"), (2, "h", "[1]")]


def test_links_from_lane_geometry(spark):
    bridge = spark.createDataFrame([(7, 0, 0, 1), (7, 0, 1, 2), (8, 1, 0, 3), (9, 2, 0, 4), (9, 2, 1, 99)], "link_id long, link_no int, group_no int, lane_group_id long")
    geometry = spark.createDataFrame([(1, 0, [0.0, 1.0], [0.0, 0.0]), (2, 1, [0.0, 0.5, 1.0], [0.0, 0.0, 0.0]), (2, 2, [9.0], [9.0]), (3, 3, [1.00004, 2.0], [0.0, 0.0]), (4, 4, [1.00008, 3.0], [0.0, 0.0])],
                                     "lane_group_id long, no int, lat array<double>, lon array<double>")
    links, made = pseudo.pseudo_links(spark, bridge, geometry)
    # 8 starts within the box of 7's end; 9 starts within the box of 8's start but not of that node's place
    assert {r.link_id: (r.u, r.v, len(r.lat)) for r in links.collect()} == {"7": ("ps_7_s", "ps_7_e", 3), "8": ("ps_7_e", "ps_8_e", 2), "9": ("ps_9_s", "ps_9_e", 2)}
    assert sorted(r.node_id for r in made.collect()) == ["ps_7_e", "ps_7_s", "ps_8_e", "ps_9_e", "ps_9_s"]
    given = spark.createDataFrame([("n1", 0, 1.00009, 0.0)], "node_id string, no int, lat double, lon double")
    assert {r.link_id: (r.u, r.v) for r in pseudo.pseudo_links(spark, bridge, geometry, given)[0].collect()} == {"7": ("ps_7_s", "ps_7_e"), "8": ("n1", "ps_8_e"), "9": ("n1", "ps_9_e")}


def test_targets_lengths_and_members(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.0), (1, 3, 9.0), (3, 4, None), (4, 5, -1.0)], "src long, dst long, weight double")
    node = lambda *n: spark.createDataFrame([(k,) for k in n], "node long")
    got = [(r.node, r.dist, r.hops_only) for r in graphs.best_targets(spark, edges, node(1), node(3, 2, 5, 77)).collect()]
    assert got == [(2, 5.0, False), (3, 6.0, False), (5, 3.0, True)]
    path = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "step int, node long")
    assert graphs.path_length(path, edges).first().total == 6.0
    places = spark.createDataFrame([(1, 0.0, 3.0), (2, 0.0, 1.0), (3, 3.0, 0.0)], "node_id long, x double, y double")
    assert [r.node_id for r in graphs.nodes_by_distance(places, 0.0, 0.0).orderBy("rank").collect()] == [2, 1, 3]
    cps = spark.createDataFrame([(1, 11, 5), (1, 10, 5), (2, 12, 6)], "node_id long, cp_id long, lane_id long")
    own = {r.node_id: (r.cp_ids, r.lanes) for r in graphs.with_members(places.select("node_id"), cps).collect()}
    assert own == {1: ([10, 11], [5]), 2: ([12], [6]), 3: ([], [])}
