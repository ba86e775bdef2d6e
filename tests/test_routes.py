import json

import pytest
from pyspark.sql import functions as F

from wayloom.functions import geodesy
from wayloom.operators import graphs, lanes, routing

LINE = "line_id long, points array<struct<x:double,y:double>>"


@pytest.fixture(scope="module")
def network(spark):
    """Lanes 1 to 4 in a row, 9 apart from them and nearer the goal."""
    rows = [(k, [(100.0 * k, 0.0), (100.0 * k + 100, 0.0)]) for k in range(1, 5)] + [(9, [(480.0, 30.0), (520.0, 30.0)])]
    edges = [(k, k + 1, k, 100.0) for k in range(1, 5)] + [(90, 91, 9, 40.0)]
    return spark.createDataFrame(rows, LINE), spark.createDataFrame(edges, "src long, dst long, lane_id long, weight double")


def test_route_takes_the_nearest_goal_lane_that_can_be_reached(spark, network):
    lines, edges = network
    got = routing.route(spark, (130.0, 4.0), (490.0, 20.0), lines, edges).orderBy("step").collect()
    assert [(r.src, r.dst, r.lane_id) for r in got] == [(1, 2, 1), (2, 3, 2), (3, 4, 3), (4, 5, 4)]
    with pytest.raises(LookupError):
        routing.route(spark, (130.0, 4.0), (9000.0, 0.0), lines, edges)
    with pytest.raises(LookupError):
        routing.route(spark, (500.0, 31.0), (110.0, 0.0), lines, edges)


def test_snapping_is_exact_for_long_lanes(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (5000.0, 0.0)]), (2, [(0.0, 40.0), (10.0, 40.0)])], LINE)
    q = spark.createDataFrame([(7, 4000.0, 12.0)], "query_id long, px double, py double")
    r = routing.snap_to_lanes(q, lines).collect()
    assert [(x.query_id, x.lane_id, x.dist, x.s, x.frac) for x in r] == [(7, 1, 12.0, 4000.0, 0.8)]
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 4100.0, 0.0)], "node_id long, x double, y double")
    assert routing.nearest_node(q, nodes).first().node_id == 2


def test_stitched_line(spark, network):
    steps = spark.createDataFrame([(0, 1, False), (1, 2, False), (2, 3, True)], "step int, lane_id long, backward boolean")
    p = routing.stitched(steps, network[0], 0.5, 0.25).first().points
    assert [(q.x, q.y) for q in p] == [(150.0, 0.0), (200.0, 0.0), (300.0, 0.0), (400.0, 0.0), (375.0, 0.0)]


def test_chains_and_superlinks(spark):
    links = spark.createDataFrame([(10, 1, 2), (11, 2, 3), (12, 4, 3), (13, 1, 5), (14, 1, 6), (20, 7, 8), (21, 8, 7)], "link_id long, u long, v long")
    got = lanes.chains(links, graphs.classify_nodes(links, links))
    rows = [(r.chain_id, r.pos, r.link_id, r.u, r.v) for r in got.orderBy("chain_id", "pos").collect()]
    assert rows == [(10, 0, 10, 1, 2), (10, 1, 11, 2, 3), (10, 2, 12, 3, 4), (13, 0, 13, 1, 5), (14, 0, 14, 1, 6)]
    bridge = spark.createDataFrame([(10, "a"), (11, "a"), (11, "b"), (12, "c")], "link_id long, lane_group_id string")
    s = {r.chain_id: r for r in lanes.superlinks(got, bridge).collect()}
    assert (s[10].src, s[10].dst, s[10].links, s[10].corridor) == (1, 4, [10, 11, 12], ["b"]) and s[13].corridor == []


def test_lane_joins(spark):
    ends = spark.createDataFrame([(1, "start", 5), (1, "end", 3), (2, "start", 3), (2, "end", 5), (3, "start", 9)], "lane_id long, endpoint string, node_id long")
    assert [tuple(r) for r in lanes.endpoint_pairs(ends).collect()] == [(3, 5)]
    assert {r.node_id: (r.lanes, r.n_start, r.n_end) for r in lanes.node_lane_lists(ends).collect()}[5] == ([1, 2], 1, 1)
    d = spark.createDataFrame([([(9.0, 0.0), (5.0, 0.0), (1.0, 0.0), (0.0, 0.0)], 1.0, 0.0, 5.0, 0.0)], "points array<struct<x:double,y:double>>, sx double, sy double, ex double, ey double")
    assert [p.x for p in lanes.orient_and_trim(d).first().points] == [1.0, 5.0]
    ls = spark.createDataFrame([(1, 10, 20)], "link_id long, u long, v long")
    b = spark.createDataFrame([(1, "g")], "link_id long, lane_group_id string")
    out, inn = (spark.createDataFrame([(n, "g")], "node_id long, lane_group_id string") for n in (10, 20))
    assert [(r.dir, r.src, r.dst) for r in lanes.link_directions(ls, b, out, inn).collect()] == [("FORWARD", 10, 20)]


def test_tiles_to_junctions(spark, tmp_path):
    from wayloom.plans.roads import junctions_from_tiles

    code = lambda lon: spark.range(1).select(geodesy.morton_encode(F.lit(52.5), F.lit(lon)).alias("c")).first().c
    c = [code(13.4 + k / 1000) for k in range(5)]
    stream = lambda k: [str(c[0] ^ c[k]), str(c[k] ^ c[k + 1])]
    road = {"here_tile_id": 1, "tile_center_here_2d_coordinate": str(c[0]), "nodes_in_tile": [],
            "links_starting_in_tile": [{"link_id": 70 + k, "start_node_id": k, "end_node_ref": {"node_id": k + 1}, "geometry": {"here_2d_coordinate_diffs": stream(k)}} for k in range(4)]}
    kinds = [{"functional_class": 1}, {"is_ramp": True}, {"is_ramp": True}, {"functional_class": 3}]
    route = {"link_attribution": [{"link_local_ref": 70 + k, "parametric_attribution": [{"applies_to_direction": "BOTH", "link_parametric_attribution": [a]}]} for k, a in enumerate(kinds)]}
    for n, b in (("ref", road), ("route", route)):
        (tmp_path / f"{n}.json").write_text(json.dumps(b))
    config = {**{f"{k}Files": [] for k in ("geom", "topo", "attr")}, "refFiles": [str(tmp_path / "ref.json")], "routeFiles": [str(tmp_path / "route.json")]}
    d = junctions_from_tiles(spark, config)
    assert [(r.seed_link_id, r.secondary_ids, r.primary_ids) for r in d.junctions.collect()] == [("71", ["71", "72"], ["70", "73"])]


def test_stream_counts(spark, tmp_path):
    from wayloom.streaming import ingest

    rows = spark.createDataFrame([("2024-01-01 00:01:00", 1), ("2024-01-01 00:02:00", 1), ("2024-01-01 01:00:00", 2)], "ts string, link_type int").select(F.to_timestamp("ts").alias("ts"), "link_type")
    rows.write.parquet(str(tmp_path / "in"))
    s = ingest.windowed_counts(ingest.link_items(spark, str(tmp_path / "in"), "ts timestamp, link_type int"))
    q = ingest.to_table(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.link_type, r.n_items) for r in got] == [(1, 2)]


def test_snapping_has_no_limit_unless_asked(spark):
    rows = [(1, [(0.0, 0.0), (5000.0, 0.0)]), (2, [(0.0, 40.0), (10.0, 40.0)]), (3, [(0.0, 90000.0), (0.0, 90010.0)])]
    lines = spark.createDataFrame(rows, LINE)
    q = spark.createDataFrame([(1, 4000.0, 12.0), (2, 2500.0, 7000.0), (3, 0.0, 89000.0), (4, None, 1.0)], "query_id long, px double, py double")
    got = [(r.query_id, r.lane_id, round(r.dist, 3), r["rank"]) for r in routing.snap_to_lanes(q, lines, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 12.0, 1), (1, 2, 3990.098, 2), (2, 1, 7000.0, 1), (2, 2, 7392.002, 2), (3, 3, 1000.0, 1), (3, 2, 88960.0, 2)]
    assert [(r.query_id, r.lane_id) for r in routing.snap_to_lanes(q, lines, 2, radius=50.0).collect()] == [(1, 1)]
    assert {r.query_id for r in routing.snap_to_lanes(q, lines, 9).groupBy("query_id").count().where("count = 3").collect()} == {1, 2, 3}
    assert routing.snap_to_lanes(q, lines.limit(0), 2).count() == 0


def test_route_without_limit_and_from_nodes(spark, network):
    lines, edges = network
    got = routing.route(spark, (130.0, 4.0), (9000.0, 0.0), lines, edges, radius=None).orderBy("step").collect()
    assert [(r.src, r.dst) for r in got] == [(1, 2), (2, 3), (3, 4), (4, 5)]
    nodes = spark.createDataFrame([(k, 100.0 * k, 0.0) for k in range(1, 6)] + [(77, 60.0, 500.0)], "node_id long, x double, y double")
    bare = lines.unionByName(spark.createDataFrame([(50, [(0.0, 495.0), (100.0, 495.0)])], LINE))
    got = routing.route(spark, (60.0, 500.0), (490.0, -20.0), bare, edges, nodes=nodes).orderBy("step").collect()  # lane 50 and node 77 aren't in the graph
    assert [(r.src, r.dst) for r in got] == [(1, 2), (2, 3), (3, 4), (4, 5)]
    with pytest.raises(LookupError):
        routing.route(spark, (60.0, 500.0), (490.0, -20.0), bare, edges)
