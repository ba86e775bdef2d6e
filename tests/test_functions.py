import json
import math

import pytest
from pyspark.sql import functions as F

from wayloom.functions import geodesy, polyline
from wayloom.functions.predicate import PredicateError, canonical, compile_predicate, select_links
from wayloom.operators import attributes, graphs, points


# the predicate language

def links_of(spark, items, text, mode="link_union"):
    rows = [(link, no, k, canonical(v)) for link, no, attrs in items for k, v in attrs.items() if v is not None]
    df = spark.createDataFrame(rows, "link_id long, item_no int, key string, value string")
    return sorted(r.link_id for r in select_links(df, text, mode).collect())


ITEMS = [(1, 1, {"is_ramp": True, "functional_class": "FC_1"}), (2, 1, {"is_ramp": True}), (2, 2, {"is_ramp": False}), (3, 1, {"functional_class": "FC_2", "n": 1}),
         (4, 1, {"functional_class": "FC_1"}), (4, 2, {"is_ramp": True}), (5, 1, {"a.b": "deep", "n": 0})]


@pytest.mark.parametrize("text,union,item", [
    ("is_ramp == true", [1, 4], [1, 2, 4]),
    ("is_ramp != true", [2, 3, 5], [2, 3, 4, 5]),
    ("not (is_ramp == true)", [2, 3, 5], [2, 3, 4, 5]),
    ('functional_class == "FC_1" and is_ramp == true', [1, 4], [1]),
    ('"FC" in functional_class', [1, 3, 4], [1, 3, 4]),
    ('"x" in missing', [], []),
    ('"x" not in missing', [], []),
    ('is_ramp == true or "x" in missing', [1, 4], [1, 2, 4]),
    ("true in is_ramp", [2], []),
    ("n == true", [3], [3]),
    ("a.b == 'deep'", [5], [5]),
    ("a['b'] == 'deep'", [5], [5]),
    ("missing == null", [1, 2, 3, 4, 5], [1, 2, 3, 4, 5]),
    ("n", [3], [3]),
    ("is_ramp", [1, 2, 4], [1, 2, 4]),
])
def test_predicates(spark, text, union, item):
    assert links_of(spark, ITEMS, text) == union
    assert links_of(spark, ITEMS, text, "any_item") == item


@pytest.mark.parametrize("text", ["f(x)", "a + 1 == 2", "a < 3", "a == b == c", "a in ['x']", "f'{a}'", "a ==", "[1]", "lambda: 1", "-a"])
def test_refused(spark, text):
    with pytest.raises(PredicateError):
        compile_predicate(text)


# geodesy

def test_codes_round_trip_and_streams(spark):
    places = [(52.5, 13.4), (-33.9, 151.2), (40.7, -74.0), (-22.9, -43.2), (0.0, 0.0), (89.9, 179.9), (-89.9, -179.9)]
    df = spark.createDataFrame(places, "lat double, lon double").withColumn("c", geodesy.morton_encode(F.col("lat"), F.col("lon")))
    for r in df.select("lat", "lon", geodesy.morton_lat(F.col("c")).alias("a"), geodesy.morton_lon(F.col("c")).alias("b")).collect():
        assert abs(r.a - r.lat) <= geodesy.STEP and abs(r.b - r.lon) <= geodesy.STEP
    one = spark.range(1).select(geodesy.parse_uint64(F.lit(" 18446744073709551615")).alias("m"), geodesy.parse_uint64(F.lit("x")).alias("n"),
                                geodesy.xor_stream(F.lit(5), F.array(F.lit(1), F.lit(2), F.lit(2))).alias("s"), geodesy.altitudes(F.lit(100), F.array(F.lit(5), F.lit(-5))).alias("h")).first()
    assert one.m == -1 and one.n is None and one.s == [4, 6, 4] and one.h == [105, 95]


def test_enu_and_back(spark):
    c = lambda v: F.lit(float(v))
    e, n, u = geodesy.to_enu(c(52.01), c(13.02), c(150), c(52), c(13), c(100))
    lat, lon, h = geodesy.from_enu(e, n, u, c(52), c(13), c(100))
    r = spark.range(1).select(e.alias("e"), n.alias("n"), lat.alias("lat"), lon.alias("lon"), h.alias("h")).first()
    assert r.lat == pytest.approx(52.01, abs=1e-9) and r.lon == pytest.approx(13.02, abs=1e-9) and r.h == pytest.approx(150, abs=1e-4)
    assert r.e == pytest.approx(1373, abs=2) and r.n == pytest.approx(1112.9, abs=2)


def test_ids_rectangles_boxes(spark):
    df = spark.createDataFrame([("'12'", 1.0, 2.0), (' "ab" ', float("nan"), 2.0), (None, 3.0, None)], "i string, x double, y double")
    got = df.select(geodesy.normal_id(F.col("i")).alias("n"), geodesy.normal_id_text(F.col("i")).alias("t"), geodesy.in_rectangle(F.col("x"), F.col("y"), 3, 3, 0, 0).alias("r")).collect()
    assert [tuple(r) for r in got] == [(12, "12", True), (None, "ab", False), (None, None, False)]
    assert tuple(geodesy.bounding_box(df, "x", "y").first()) == (1.0, 1.0, 2.0, 2.0)


# polylines

def line(spark, pts):
    return spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in pts],)], "p array<struct<x:double,y:double>>")


def xy(points_):
    return [(round(q.x, 6), round(q.y, 6)) for q in points_]


def test_polylines(spark):
    d = line(spark, [(0, 0), (3, 4), (3, 10)])
    p = F.col("p")
    r = d.select(polyline.length(p).alias("len"), polyline.arclengths(p).alias("s"), polyline.cut(p, F.lit(0.75), F.lit(0.25)).alias("cut"), polyline.point_at(p, F.lit(8.0)).alias("at"), polyline.direction_at(p, F.lit(0.9)).alias("dir"),
                 polyline.clip_to_length(p, 6.0).alias("clip"), polyline.total_turn(p).alias("turn"), polyline.signed_area(p).alias("area"),
                 polyline.orient(p, polyline.point(F.lit(3), F.lit(10)), polyline.point(F.lit(0), F.lit(0))).alias("o"), polyline.angular_span(F.array(F.lit(10.0), F.lit(350.0), F.lit(90.0))).alias("span")).first()
    assert r.len == 11 and r.s == [0, 5, 11] and xy([r["at"]]) == [(3, 7)] and xy([r.dir]) == [(0, 1)]
    assert xy(r.cut) == [(1.65, 2.2), (3, 4), (3, 7.25)] and xy(r.clip) == [(0, 0), (3, 4)] and xy(r.o) == [(3, 10), (3, 4), (0, 0)]
    assert r.turn == pytest.approx(90 - math.degrees(math.atan2(4, 3))) and r.area == pytest.approx(9) and r.span == pytest.approx(100)
    bad = line(spark, [(0, 0), (0, 0), (float("nan"), 1), (1, 1)]).select(polyline.clean(p).alias("c")).first()
    assert xy(bad.c) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("n", [0, 1, 64, 65, 200])
def test_subsample(spark, n):
    got = xy(line(spark, [(k, 0) for k in range(n)]).select(polyline.subsample(F.col("p")).alias("s")).first().s)
    want = list(range(n)) if n <= 64 else [round(k * ((n - 1) / 63.0)) for k in range(64)]
    assert [x for x, _ in got] == want


def test_crossing_and_hull(spark):
    pt = lambda x, y: polyline.point(F.lit(x), F.lit(y))
    r = spark.range(1).select(polyline.segments_cross(pt(0, 0), pt(2, 2), pt(0, 2), pt(2, 0), False).alias("a"), polyline.segments_cross(pt(0, 0), pt(2, 2), pt(2, 2), pt(3, 0)).alias("b"),
                              polyline.segments_cross(pt(0, 0), pt(2, 2), pt(2, 2), pt(3, 0), False).alias("c"), polyline.segments_cross(pt(0, 0), pt(1, 0), pt(0, 1), pt(1, 1)).alias("d")).first()
    assert tuple(r) == (True, True, False, False)
    hull = line(spark, [(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 0), (0, 0)]).select(polyline.convex_hull("p").alias("h")).first().h
    assert xy(hull) == [(0, 0), (2, 0), (2, 2), (0, 2)]


# attributes and graphs

def test_intervals(spark):
    rows = [(1, "F", 0.1, 0.3), (1, "F", 0.3, 0.5), (1, "F", 0.45, 0.6), (1, "F", 0.8, 1.4), (1, "B", 0.5, 0.5), (1, "B", 0.9, 0.2), (2, "F", -1.0, 0.1)]
    got = attributes.coalesce_intervals(spark.createDataFrame(rows, "g long, d string, s0 double, s1 double"), ["g", "d"]).collect()
    assert sorted((r.g, r.d, r.s0, r.s1) for r in got) == [(1, "F", 0.1, 0.6), (1, "F", 0.8, 1.0), (2, "F", 0.0, 0.1)]


def test_ranges(spark):
    cases = [("0.2", "0.6", None, None, 0.2, 0.6), (None, None, "0.3", None, 0.3, 1.0), (None, None, None, "0.4", 0.0, 0.6), (None, None, "0.1", "0.2", 0.1, 0.8), ("0.9", "0.1", None, None, 0.0, 1.0), ("x", "0.5", None, None, 0.0, 1.0), ("-3", "9", None, None, 0.0, 1.0)]
    df = spark.createDataFrame([c[:4] for c in cases], "a string, b string, c string, d string")
    got = [tuple(r.r) for r in df.select(attributes.range_of(*[F.col(x) for x in "abcd"]).alias("r")).collect()]
    assert [(round(a, 9), round(b, 9)) for a, b in got] == [c[4:] for c in cases]


def test_node_classes(spark):
    rows = [(1, 1, 2), (2, 2, 3), (3, 2, 4), (4, 9, 9), (5, 4, 5)]
    links = spark.createDataFrame(rows, "link_id long, u long, v long")
    got = {r.node_id: r.node_class for r in graphs.classify_nodes(links, links).collect()}
    assert got == {1: "dead_end", 2: "junction", 3: "dead_end", 4: "chain", 5: "dead_end", 9: "none"}


def test_routes(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0), (4, 1, 1.0), (7, 8, 1.0), (9, 3, 0.5)], "src long, dst long, weight double")
    starts = spark.createDataFrame([(1,), (9,)], "node long")
    paths = graphs.shortest_paths(spark, edges, starts)
    assert {r.node: (r.dist, r.source) for r in paths.collect()} == {1: (0.0, 1), 9: (0.0, 9), 2: (1.0, 1), 3: (0.5, 9), 4: (1.5, 9)}
    assert graphs.path_to(spark, paths, 4) == [9, 3, 4] and graphs.path_to(spark, paths, 8) == []
    one, ends = spark.createDataFrame([(9,)], "node long"), spark.createDataFrame([(2,), (8,)], "node long")
    assert sorted(r.node for r in graphs.nodes_between(spark, edges, one, ends).collect()) == [1, 2, 3, 4, 9]
    assert graphs.nodes_between(spark, edges, one, ends, every=True).count() == 0


def test_directions(spark):
    rows = spark.createDataFrame([(1, "FORWARD"), (1, "BACKWARD"), (2, "BOTH"), (3, None), (4, "forward")], "group_id long, direction string")
    got = {r.group_id: r.allowed for r in attributes.group_directions(spark.range(1, 6).withColumnRenamed("id", "group_id"), rows).collect()}
    assert got == {1: "BOTH", 2: "BOTH", 3: "NONE", 4: "FWD", 5: "UNKNOWN"}


def test_connection_point_rules(spark):
    cols = "cp_id long, node_id long, link_id long, link_end string, x double, y double, d_node double, d_seg double, edges array<long>"
    rows = [(1, 1, 10, "start", 0.0, 1.0, 1.0, 0.0, [5]), (2, 1, 11, "end", 1.0, 0.0, 1.0, 0.0, [5, 6]), (3, 1, 12, "start", 5.0, 5.0, 9.0, 0.0, [7]), (4, 2, 13, "end", 0.0, 0.0, 1.0, 0.0, [8])]
    df = spark.createDataFrame(rows, cols)
    ids = lambda d: sorted(r.cp_id for r in d.collect())
    assert ids(points.drop_unlinked(df)) == [1, 2] and ids(points.drop_unlinked(df, True)) == [1, 2, 4]
    assert ids(points.peer_filter(df)) == [1, 2, 3, 4]
    ends = spark.createDataFrame([(1, 10, "end", 3.0, 3.0), (1, 10, "start", 0.0, 0.0)], "node_id long, link_id long, link_end string, x double, y double")
    made = points.cover_link_ends(df, ends).where("synthetic").collect()
    assert [(r.cp_id, r.link_end) for r in made] == [(5, "end")]
    assert {1, 2} <= set(ids(points.sector_cull(df)))


# documents and tiles

def test_graph_document_round_trip(spark, tmp_path):
    from wayloom.sources import documents

    xy_ = "array<struct<x:double,y:double>>"
    rows = spark.createDataFrame([(0, 10, 2, [1], [(0.0, 1.0)]), (1, 100, 1, [0], []), (2, 9, 0, [], [(2.0, 3.0), (4.0, 5.0)])], f"idx int, link_id long, link_type int, neighbours array<int>, points {xy_}")
    doc = documents.graph_document(rows, "config1").first().value
    assert json.loads(doc)["row_offsets"] == [0, 1, 2, 2]
    (tmp_path / "g.json").write_text(doc)
    v, e = documents.read_graph(spark, str(tmp_path / "g.json"))
    assert sorted((r.idx, r.link_id, r.link_type, len(r.points)) for r in v.collect()) == [(0, 10, 2, 1), (1, 100, 1, 0), (2, 9, 0, 2)]
    assert sorted((r.src, r.dst) for r in e.collect()) == [(10, 100), (100, 10)]
    (tmp_path / "bad.json").write_text(doc.replace('"row_offsets":[0,1,2,2]', '"row_offsets":[0,1]'))
    with pytest.raises(Exception, match="do not fit"):
        documents.read_graph(spark, str(tmp_path / "bad.json"))[0].collect()


def test_documents_hold_all_their_parts(spark, tmp_path):
    from wayloom.sources import documents

    xy_ = "array<struct<x:double,y:double>>"
    shape = f"idx int, link_id long, link_type int, neighbours array<int>, points {xy_}, x0 double, y0 double, x1 double, y1 double"
    rows = spark.createDataFrame([(0, 10, 2, [1, 2], [(0.0, 1.0)], 7.0, 7.5, 8.0, 8.5), (1, 100, 1, [0], [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], None, 1.0, 1.0, 1.0), (2, 9, 2, [0], [], None, None, None, None)], shape)
    around = spark.createDataFrame([(5, [(0.0, 0.0), (1.0, 2.0)]), (4, [(9.0, 9.0)]), (3, [(4.0, 4.0), (5.0, 5.0), (6.0, 7.0)])], f"link_id long, points {xy_}")
    doc = json.loads(documents.graph_document(rows, "c", around, ramp_only=False, seconds=1.5).first().value)
    assert len(doc) == 24
    assert doc["classification"] == {"ramp_only": False, "num_secondary_ids": 2, "num_primary_ids": 1}
    assert doc["summary"] == {"num_dual_vertices": 3, "num_dual_directed_edges": 4, "num_background_links": 2, "export_time_s": 1.5}
    assert (doc["row_offsets"], doc["point_offsets"], doc["point_x"]) == ([0, 2, 3, 4], [0, 1, 4, 4], [0.0, 1.0, 2.0, 3.0])
    assert [doc[f"link_plot_{c}"] for c in documents.ENDS] == [[7.0, 1.0, "NaN"], [7.5, 1.0, "NaN"], [8.0, 3.0, "NaN"], [8.5, 4.0, "NaN"]]
    assert (doc["background_link_ids"], doc["background_point_offsets"], doc["background_plot_y1"]) == ([3, 5], [0, 3, 5], [7.0, 2.0])
    path = tmp_path / "g.json"
    path.write_text(json.dumps(doc))
    ends = lambda r: (r.x0, r.y0, r.x1, r.y1)
    v = {r.link_id: r for r in documents.read_graph(spark, str(path))[0].collect()}
    assert ends(v[10]) == (7.0, 7.5, 8.0, 8.5) and ends(v[100]) == (1.0, 1.0, 3.0, 4.0) and math.isnan(v[9].x0)
    assert {r.link_id: ends(r) for r in documents.read_background(spark, str(path)).collect()} == {3: (4.0, 4.0, 6.0, 7.0), 5: (0.0, 0.0, 1.0, 2.0)}
    old = {k: x for k, x in doc.items() if "plot" not in k}  # without ends: those of the points, else 0
    path.write_text(json.dumps(old))
    v = {r.link_id: ends(r) for r in documents.read_graph(spark, str(path))[0].collect()}
    assert v == {10: (0.0,) * 4, 100: (1.0, 1.0, 3.0, 4.0), 9: (0.0,) * 4}
    path.write_text(json.dumps({**doc, "link_plot_y1": [1.0]}))
    with pytest.raises(Exception, match="plot arrays"):
        documents.read_graph(spark, str(path))[0].collect()
    empty = json.loads(documents.graph_document(rows.limit(0), "c").first().value)
    assert empty["row_offsets"] == [0] and empty["background_point_offsets"] == [0] and empty["num_links"] == 0


def test_junction_document(spark):
    from wayloom.operators.junctions import link_roles
    from wayloom.sources import documents

    found = spark.createDataFrame([(2, 30, [30], [31]), (1, 10, [10, 12], [11])], "junction_id long, seed_link_id long, secondary_ids array<long>, primary_ids array<long>")
    ends = spark.createDataFrame([(i, float(i), 0.0, i + 1.0, 0.5) for i in (10, 11, 12, 30)], "link_id long, x0 double, y0 double, x1 double, y1 double")
    lines = documents.plot_lines(ends)
    doc = json.loads(documents.junction_document(found, link_roles(found), lines, lines.where("link_id < 12"), 5, 8, "c", 2.0).first().value)
    assert doc["summary"] == {"num_dual_vertices": 5, "num_dual_directed_edges": 8, "num_junctions": 2, "runtime_s": 2.0}
    a, b = doc["interchanges"]
    assert (a["id"], a["seed_link_id"], a["all_link_ids"], a["graph"]["nodes"]) == (1, 10, [10, 11, 12], [])
    assert [(e["u"], e["v"], e["role"]) for e in a["graph"]["edges"]] == [(20, 21, "ramp"), (22, 23, "main"), (24, 25, "ramp")]
    assert a["graph"]["edges"][0]["polyline"] == [[10.0, 0.0], [11.0, 0.5]]
    assert [e["link_id"] for e in b["graph"]["edges"]] == [30]  # 31 isn't in the graph
    assert [(e["link_id"], "role" in e) for e in doc["background_graph"]["edges"]] == [(10, False), (11, False)]


def test_tiles(spark, tmp_path):
    from wayloom.sources import tiles

    code = lambda lat, lon: spark.range(1).select(geodesy.morton_encode(F.lit(lat), F.lit(lon)).alias("c")).first().c
    centre, a, b = code(52.5, 13.4), code(52.51, 13.41), code(52.52, 13.42)
    one = {"here_tile_id": 7, "tile_center_here_2d_coordinate": str(centre), "tile_center_here_3d_coordinate": {"cm_from_wgs84_ellipsoid": 3500},
           "nodes_in_tile": [{"node_id": "1", "geometry": {"here_2d_coordinate": str(centre ^ a)}}, {"node_id": 2}],
           "links_starting_in_tile": [{"link_id": 50, "start_node_id": 1, "end_node_ref": {"node_id": 2}, "link_length_meters": 12.5, "geometry": {"here_2d_coordinate_diffs": [str(centre ^ a), str(a ^ b)], "cm_from_wgs84_ellipsoid_diffs": [1, 2]}}, {"link_id": 51}],
           "link_lane_group_references": [{"link_local_ref": 50, "lane_group_references": [{"lane_group_ref": {"lane_group_id": "g1"}}]}]}
    route = {"here_tile_id": 7, "link_attribution": [{"link_local_ref": 50, "parametric_attribution": [
        {"applies_to_direction": "BOTH", "applies_to_range": {}, "link_parametric_attribution": [{"is_ramp": True}, {"functional_class": 2}]},
        {"applies_to_direction": "BOTH", "applies_to_range": {}, "link_parametric_attribution": [{"is_ramp": True}, {"functional_class": 2}]}]},
        {"link_local_ref": 51, "parametric_attribution": [{"applies_to_direction": "FORWARD", "link_parametric_attribution": {"is_ramp": False, "functional_class": 1}}]}]}
    for name, body in (("t", one), ("r", route)):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "broken.json").write_text("{")
    t = tiles.read_tiles(spark, [str(tmp_path / "broken.json"), str(tmp_path / "t.json")])
    links = tiles.road_links(t)
    got = links.collect()
    assert [(r.link_id, r.start_node_id, r.end_node_id, r.length_m) for r in got] == [("50", "1", "2", 12.5)]
    assert got[0].lat == pytest.approx([52.51, 52.52], abs=1e-6) and got[0].lon == pytest.approx([13.41, 13.42], abs=1e-6)
    nodes = {r.node_id: r for r in tiles.road_nodes(t, links).collect()}
    assert nodes["1"].lat == pytest.approx(52.51, abs=1e-6) and nodes["2"].lat == pytest.approx(52.52, abs=1e-6) and nodes["2"].in_links == ["50"]
    assert [tuple(r) for r in tiles.lane_group_links(t).collect()] == [("50", "g1")]
    assert [(r.tile_no, r.origin_alt_m) for r in tiles.origins(t).collect()] == [(1, 35.0)]
    items = tiles.routing_items(tiles.read_tiles(spark, [str(tmp_path / "r.json")]))
    assert items.count() == 2
    vals = tiles.attribute_values(items)
    assert [r.link_id for r in select_links(vals, 'is_ramp == true and functional_class == "FC_2"').collect()] == ["50"]
    assert [r.link_id for r in select_links(vals, 'functional_class == "FC_1"').collect()] == ["51"]
    rows = tiles.link_rows(links, 52.5, 13.4).first()
    assert len(rows.points) == 2 and rows.points[0].x == pytest.approx(679, abs=3)


def test_lane_tiles(spark, tmp_path):
    from wayloom.sources import tiles

    geo = {"here_tile_id": 1, "origin_lat": 52.0, "origin_lon": 13.0, "origin_alt_cm": 100, "lane_group_geometries": [
        {"reference_geometry": [{"lane_group_ref": "g", "lat": [52.0], "lon": [13.0], "alt_cm": [5]}], "lane_geometries": [{"lane_group_ref": "g", "lat": [52.0, 52.1], "lon": [13.0, 13.1], "alt_cm": [1, 2], "lane_number": 3}]}]}
    topo = {"lane_groups_starting_in_tile": [{"lane_group_id": "g", "start_lane_group_connector_ref": 4, "end_lane_group_connector_ref": {"lane_group_connector_id": 5}, "lane_group_length_meters": 9, "lanes": [{"start_lane_connector_number": 1, "end_lane_connector_number": 2}]}, {"end_lane_group_connector_ref": 6}]}
    attr = {"lane_group_attribution": [{"lane_group_ref": "g", "lane_attribution": [{"lane_number": 3, "parametric_attribution": [{"applies_to_range": {"range_offset_from_start": 0.5}, "lane_parametric_attribution": {"direction_of_travel": 2, "lane_type": "REGULAR"}}]}]}]}
    for n, b in (("g", geo), ("t", topo), ("a", attr)):
        (tmp_path / f"{n}.json").write_text(json.dumps(b))
    read = lambda n: tiles.read_tiles(spark, [str(tmp_path / f"{n}.json")])
    g = tiles.lane_geometry(read("g"))
    assert [(r.lane_group_ref, r.number, r.lat) for r in g["lanes"].collect()] == [("g", 3, [52.0, 52.1])] and g["reference"].count() == 1 and g["boundaries"].count() == 0
    assert [(r.lane_group_id, r.start_connector_id, r.end_connector_id, r.length_m, len(r.lanes)) for r in tiles.lane_topology(read("t")).orderBy("end_connector_id").collect()] == [("g", "4", "5", 9.0, 1), ("UNKNOWN_2", None, "6", None, 0)]
    assert [tuple(r)[:4] + (r.s0, r.s1) for r in tiles.lane_attribute_items(read("a")).collect()] == [("g", 3, "FORWARD", "REGULAR", 0.5, 1.0)]


def test_lane_attribution(spark, tmp_path):
    from wayloom.operators.attributes import lane_attributes
    from wayloom.sources import tiles

    part = lambda s0, s1, **k: {"applies_to_range": {"start": s0, "end": s1}, **k}
    lane = lambda *items: part(0.0, 0.5, lane_parametric_attribution=list(items))
    mark = lambda x: {"lane_boundary_marking": x}
    group = {"lane_group_ref": "g",
             "lane_attribution": [{"lane_number": 1, "parametric_attribution": [lane({"direction_of_travel": 4}, {"direction_of_travel": "both", "lane_within_intersection": False})]},
                                  {"lane_number": "2", "parametric_attribution": [lane({"direction_of_travel": "backward", "lane_type": "HOV"})]}],
             "lane_boundary_attribution": [
                 {"lane_boundary_number": 1, "parametric_attribution": [part(0.2, 0.4, lane_boundary_parametric_attribution=[mark({"kind": "SOLID"}), mark(None), {}])]},
                 {"lane_boundary_number": 2, "parametric_attribution": [], "lane_boundary_point_attribution": [part(0.0, 1.0, lane_boundary_parametric_attribution=mark("DASHED"))]},
                 {"lane_boundary_number": "x", "parametric_attribution": [part(0.0, 1.0, lane_boundary_parametric_attribution=[mark("LOST")])]}],
             "parametric_attribution": [part(0.1, 0.9, lane_group_parametric_attribution=[{"speed": 5}, {"speed": 5}])]}
    (tmp_path / "a.json").write_text(json.dumps({"lane_group_attribution": [group, {"lane_group_ref": "bare"}]}))
    t = tiles.read_tiles(spark, [str(tmp_path / "a.json")])
    lanes = {r.lane_no: r for r in lane_attributes(tiles.lane_attribute_items(t)).collect()}
    assert (lanes[1].directions, lanes[1].in_intersection) == (["BACKWARD", "FORWARD"], True)
    assert (lanes[2].directions, lanes[2].types, lanes[2].in_intersection) == (["BACKWARD"], ["HOV"], False)
    assert sorted(map(tuple, tiles.boundary_marking_items(t).collect())) == [("g", 1, 0.2, 0.4, '{"kind":"SOLID"}'), ("g", 2, 0.0, 1.0, '"DASHED"')]
    assert list(map(tuple, tiles.group_parameter_items(t).collect())) == [("g", 0.1, 0.9, '{"speed":5}')] * 2


def test_configurations():
    from wayloom.sources.tiles import is_synthetic, tile_files

    five = {f"{k}Files": [k] for k in ("geom", "topo", "attr", "ref", "route")}
    assert tile_files(five)["geom"] == ["geom"]
    assert tile_files({"geomPrefix": "g/", "tiles": [1, 2]}) == {"geom": ["g/1.json", "g/2.json"], "topo": [], "attr": [], "ref": [], "route": [], "topoGeom": []}
    with pytest.raises(ValueError):
        tile_files({})
    assert is_synthetic({"Synthetic": True}) and not is_synthetic({}) and not is_synthetic(None)


def test_equal_intervals_are_one_island(spark):
    """Repeated intervals neither split an island nor join the one before."""
    from wayloom.operators.attributes import coalesce_intervals

    rows = [(g, a, b) for g in range(200) for a, b in ((0.54, 0.77), (0.97, 1.0), (0.97, 1.2), (0.97, 1.0), (0.18, 0.19))]
    out = coalesce_intervals(spark.createDataFrame(rows, "g long, s0 double, s1 double").repartition(7), ["g"]).collect()
    assert sorted(map(tuple, out)) == [(g, a, b) for g in range(200) for a, b in ((0.18, 0.19), (0.54, 0.77), (0.97, 1.0))]
