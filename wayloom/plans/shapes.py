"""Registered queries of lines, geodesy and keyed joins, and their SQL twins.

The lines are the orders: a point for each order line, some of them repeated or
collinear, some lines of one point only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.functions import geodesy, polyline
from wayloom.operators import attributes, graphs, lanes, points, routing
from wayloom.plans.catalogue import LINKS, query, text_of
from wayloom.sources import fixtures

_LI = """li AS (SELECT l_orderkey AS line_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS i,
  (l_partkey % 100)::DOUBLE AS x, (l_suppkey % 10 * 7)::DOUBLE AS y FROM lineitem),
st AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, count(*) OVER (PARTITION BY line_id) AS n FROM li WINDOW w AS (PARTITION BY line_id ORDER BY i)),
le AS (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS d FROM st),
arc AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY line_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM le),
tot AS (SELECT line_id, max(s) AS total, max(n) AS n FROM arc GROUP BY 1)"""
_AT = lambda name, f: f"""{name} AS (SELECT line_id, arg_max(x + (nx - x) * g, i) AS x, arg_max(y + (ny - y) * g, i) AS y, arg_max(nx - x, i) AS dx, arg_max(ny - y, i) AS dy, arg_max(d, i) AS d
  FROM (SELECT *, CASE WHEN d > 0 THEN least(({f} * total - s) / d, 1) ELSE 0 END AS g FROM arc JOIN tot USING (line_id)) WHERE nx IS NOT NULL AND s <= {f} * total GROUP BY 1)"""  # noqa: E731


def _lines(spark, sf_dir) -> DataFrame:
    l = fixtures.table(spark, sf_dir, "lineitem")
    p = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", polyline.point(F.col("l_partkey") % 100, F.col("l_suppkey") % 10 * 7).alias("p"))
    return l.groupBy(F.col("l_orderkey").alias("line_id")).agg(F.array_sort(F.collect_list(p)).alias("z")).select("line_id", F.transform("z", lambda z: z["p"]).alias("p"))


def _r(c, name: str, digits: int = 5):
    return F.round(c, digits).alias(name)


# lines

@query(f"WITH {_LI} SELECT line_id, i::INT AS pos, round(s, 5) AS s FROM arc")
def polyline_arclengths(spark, sf_dir) -> DataFrame:
    return _lines(spark, sf_dir).select("line_id", F.posexplode(polyline.arclengths(F.col("p"))).alias("k", "s")).select("line_id", (F.col("k") + 1).alias("pos"), _r("s", "s"))


@query(f"WITH {_LI}, {_AT('a', '0.37')} SELECT line_id, round(x, 5) AS x, round(y, 5) AS y FROM a")
def polyline_point_at(spark, sf_dir) -> DataFrame:
    p = F.col("p")
    at = _lines(spark, sf_dir).where(F.size(p) >= 2).withColumn("q", polyline.point_at(p, polyline.length(p) * 0.37))
    return at.select("line_id", _r("q.x", "x"), _r("q.y", "y"))


@query(f"WITH {_LI}, {_AT('a', '0.61')} SELECT line_id, round(CASE WHEN d > 0 THEN dx / d ELSE 0 END, 5) AS dx, round(CASE WHEN d > 0 THEN dy / d ELSE 0 END, 5) AS dy FROM a")
def polyline_direction_at(spark, sf_dir) -> DataFrame:
    lines = _lines(spark, sf_dir).where(F.size("p") >= 2).withColumn("q", polyline.direction_at(F.col("p"), F.lit(0.61)))
    return lines.select("line_id", _r("q.x", "dx"), _r("q.y", "dy"))


@query(f"""WITH {_LI}, {_AT('a', '0.2')}, {_AT('b', '0.7')}, c AS (SELECT line_id, count(*) AS k, sum(x) AS x, sum(y) AS y FROM arc JOIN tot USING (line_id) WHERE s > 0.2 * total AND s < 0.7 * total GROUP BY 1)
SELECT line_id, (2 + coalesce(c.k, 0))::INT AS n_points, round(total / 2, 5) AS length, round(a.x + b.x + coalesce(c.x, 0), 5) AS sum_x, round(a.y + b.y + coalesce(c.y, 0), 5) AS sum_y
FROM a JOIN b USING (line_id) JOIN tot USING (line_id) LEFT JOIN c USING (line_id)""")
def polyline_cut(spark, sf_dir) -> DataFrame:
    lines = _lines(spark, sf_dir).where(F.size("p") >= 2).withColumn("c", polyline.cut(F.col("p"), F.lit(0.7), F.lit(0.2)))
    total = lambda k: F.aggregate("c", F.lit(0.0), lambda s, q: s + q[k])
    return lines.select("line_id", F.size("c").alias("n_points"), _r(polyline.length(F.col("c")), "length"), _r(total("x"), "sum_x"), _r(total("y"), "sum_y"))


@query(f"WITH {_LI}, k AS (SELECT line_id, greatest(count(*) FILTER (s <= 60), least(2, max(n))) AS k FROM arc GROUP BY 1) SELECT line_id, k::INT AS n_points, x, y FROM k JOIN li USING (line_id) WHERE i = k")
def polyline_clip(spark, sf_dir) -> DataFrame:
    lines = _lines(spark, sf_dir).withColumn("c", polyline.clip_to_length(F.col("p"), 60.0))
    last = F.element_at("c", -1)
    return lines.select("line_id", F.size("c").alias("n_points"), last["x"].alias("x"), last["y"].alias("y"))


@query(f"""WITH {_LI}, o AS (SELECT line_id, i, CASE WHEN x % 11 <> 3 AND x % 13 <> 5 THEN floor(x / 40) END AS x, floor(y / 30) AS y FROM li),
f AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM o WHERE x IS NOT NULL WINDOW w AS (PARTITION BY line_id ORDER BY i))
SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY i)::INT AS pos, x, y FROM f WHERE px IS NULL OR px <> x OR py <> y""")
def polyline_clean(spark, sf_dir) -> DataFrame:
    odd = lambda q: F.struct(F.when(q["x"] % 11 == 3, F.lit(float("inf"))).when(q["x"] % 13 != 5, F.floor(q["x"] / 40).cast("double")).alias("x"), F.floor(q["y"] / 30).cast("double").alias("y"))
    lines = _lines(spark, sf_dir).select("line_id", F.posexplode(polyline.clean(F.transform("p", odd))).alias("k", "q"))
    return lines.select("line_id", (F.col("k") + 1).alias("pos"), "q.x", "q.y")


@query("""WITH l AS (SELECT l_partkey % 50 AS line_id, row_number() OVER (PARTITION BY l_partkey % 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS i, l_orderkey::DOUBLE AS x, (l_suppkey % 50)::DOUBLE AS y FROM lineitem),
n AS (SELECT line_id, count(*) AS n FROM l GROUP BY 1),
k AS (SELECT line_id, k, CASE WHEN n > 64 THEN round_even(k * ((n - 1) / 63.0::DOUBLE), 0) ELSE k END AS i FROM n, range(64) t(k) WHERE n > 64 OR k < n)
SELECT line_id, k::INT AS pos, x, y FROM k JOIN l USING (line_id, i)""")
def polyline_subsample(spark, sf_dir) -> DataFrame:
    l = fixtures.table(spark, sf_dir, "lineitem")
    p = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", polyline.point(F.col("l_orderkey"), F.col("l_suppkey") % 50).alias("p"))
    lines = l.groupBy((F.col("l_partkey") % 50).alias("line_id")).agg(F.array_sort(F.collect_list(p)).alias("z"))
    return lines.select("line_id", F.posexplode(polyline.subsample(F.transform("z", lambda z: z["p"]))).alias("pos", "q")).select("line_id", "pos", "q.x", "q.y")


@query(f"""WITH {_LI}, h AS (SELECT line_id, i, degrees(atan2(ny - y, nx - x)) AS h FROM le WHERE nx IS NOT NULL),
t AS (SELECT line_id, h - lag(h) OVER (PARTITION BY line_id ORDER BY i) + 180 AS w FROM h)
SELECT line_id, round(sum(abs(w - 360 * floor(w / 360) - 180)), 4) AS turn FROM t WHERE w IS NOT NULL GROUP BY 1""")
def polyline_total_turn(spark, sf_dir) -> DataFrame:
    return _lines(spark, sf_dir).where(F.size("p") >= 3).select("line_id", _r(polyline.total_turn(F.col("p")), "turn", 4))


@query(f"""WITH {_LI}, r AS (SELECT *, coalesce(nx, first_value(x) OVER w) AS rx, coalesce(ny, first_value(y) OVER w) AS ry FROM st WINDOW w AS (PARTITION BY line_id ORDER BY i))
SELECT line_id, sum(x * ry - rx * y) / 2 AS area FROM r WHERE n >= 3 GROUP BY 1""")
def polyline_signed_area(spark, sf_dir) -> DataFrame:
    return _lines(spark, sf_dir).where(F.size("p") >= 3).select("line_id", polyline.signed_area(F.col("p")).alias("area"))


_TURN = lambda p, q, r: f"(({q}.x - {p}.x) * ({r}.y - {p}.y) - ({q}.y - {p}.y) * ({r}.x - {p}.x))"
_ON = lambda p, q, r: f"({r}.x BETWEEN least({p}.x, {q}.x) AND greatest({p}.x, {q}.x) AND {r}.y BETWEEN least({p}.y, {q}.y) AND greatest({p}.y, {q}.y))"
_STRICT = f"({_TURN('a', 'b', 'c')} * {_TURN('a', 'b', 'd')} < 0 AND {_TURN('c', 'd', 'a')} * {_TURN('c', 'd', 'b')} < 0)"
_TOUCH = " OR ".join(f"({_TURN(p, q, r)} = 0 AND {_ON(p, q, r)})" for p, q, r in (("a", "b", "c"), ("a", "b", "d"), ("c", "d", "a"), ("c", "d", "b")))


@query(f"""WITH {_LI}, f AS (SELECT line_id, i, {{'x': floor(x / 9), 'y': floor(y / 9)}} AS p FROM li)
SELECT line_id, {_STRICT} AS crosses, ({_STRICT} OR {_TOUCH}) AS touches FROM (SELECT w.line_id, w.p AS a, x.p AS b, y.p AS c, z.p AS d FROM f w JOIN f x ON x.line_id = w.line_id AND w.i = 1 AND x.i = 2
  JOIN f y ON y.line_id = w.line_id AND y.i = 3 JOIN f z ON z.line_id = w.line_id AND z.i = 4)""")
def segment_crossings(spark, sf_dir) -> DataFrame:
    p = F.transform("p", lambda q: F.struct(F.floor(q["x"] / 9).alias("x"), F.floor(q["y"] / 9).alias("y")))
    four = _lines(spark, sf_dir).where(F.size("p") >= 4).withColumn("p", p).select("line_id", *[F.get("p", F.lit(k)).alias(c) for k, c in enumerate("abcd")])
    ends = [F.col(c) for c in "abcd"]
    return four.select("line_id", polyline.segments_cross(*ends, touching=False).alias("crosses"), polyline.segments_cross(*ends).alias("touches"))


@query("""WITH a AS (SELECT c_nationkey AS id, (c_custkey * 37 % 210)::DOUBLE - 100 AS d FROM customer WHERE c_acctbal > 5000), w AS (SELECT id, d - 360 * floor(d / 360) AS d FROM a),
g AS (SELECT id, coalesce(lead(d) OVER o, min(d) OVER (PARTITION BY id) + 360) - d AS gap, count(*) OVER (PARTITION BY id) AS n FROM w WINDOW o AS (PARTITION BY id ORDER BY d))
SELECT id, CASE WHEN max(n) > 1 THEN 360 - max(gap) ELSE 0 END AS span FROM g GROUP BY 1""")
def angular_spans(spark, sf_dir) -> DataFrame:
    a = fixtures.table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("id"))
    return a.agg(F.collect_list((F.col("c_custkey") * 37 % 210).cast("double") - 100).alias("d")).select("id", polyline.angular_span(F.col("d")).alias("span"))


@query(f"""WITH {_LI}, e AS (SELECT line_id, arg_min(x, i) AS fx, arg_min(y, i) AS fy, arg_max(x, i) AS lx, arg_max(y, i) AS ly, max(n) AS n FROM st GROUP BY 1),
t AS (SELECT *, (line_id % 100)::DOUBLE AS sx, 30.0::DOUBLE AS sy, (line_id % 37)::DOUBLE AS ex, 5.0::DOUBLE AS ey FROM e WHERE n >= 2),
d AS (SELECT *, sqrt((fx - sx) ** 2 + (fy - sy) ** 2) + sqrt((lx - ex) ** 2 + (ly - ey) ** 2) AS ahead, sqrt((lx - sx) ** 2 + (ly - sy) ** 2) + sqrt((fx - ex) ** 2 + (fy - ey) ** 2) AS back FROM t)
SELECT line_id, CASE WHEN ahead <= back THEN fx ELSE lx END AS x, CASE WHEN ahead <= back THEN fy ELSE ly END AS y FROM d WHERE abs(ahead - back) > 1e-9 OR (fx = lx AND fy = ly)""")
def polyline_orientation(spark, sf_dir) -> DataFrame:
    k, p = F.col("line_id"), F.col("p")
    start, end = polyline.point(k % 100, F.lit(30.0)), polyline.point(k % 37, F.lit(5.0))
    off = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    first, last = F.get(p, F.lit(0)), F.element_at(p, -1)
    tie = F.abs(off(first, start) + off(last, end) - off(last, start) - off(first, end)) <= 1e-9  # rounding decides those
    lines = _lines(spark, sf_dir).where(F.size(p) >= 2).where(~tie | (first == last)).withColumn("q", F.get(polyline.orient(p, start, end), F.lit(0)))
    return lines.select("line_id", "q.x", "q.y")


# geodesy and ids

def _positions(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return fixtures.table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7919 % 17800) / 100 - 89).alias("lat"), ((k * 104729 % 35900) / 100 - 179).alias("lon"), (F.col("c_acctbal") / 10).alias("h"))


_POS = "pos AS (SELECT c_custkey AS id, (c_custkey * 7919 % 17800) / 100.0::DOUBLE - 89 AS lat, (c_custkey * 104729 % 35900) / 100.0::DOUBLE - 179 AS lon, c_acctbal::DOUBLE / 10 AS h FROM customer)"


@query(f"WITH {_POS} SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, round(h, 3) AS h FROM pos")
def ecef_round_trip(spark, sf_dir) -> DataFrame:
    """Positions to earth-centred coordinates and back: the twin is the positions themselves."""
    lat, lon, h = geodesy.from_ecef(*geodesy.to_ecef(F.col("lat"), F.col("lon"), F.col("h")))
    return _positions(spark, sf_dir).select("id", _r(lat, "lat", 6), _r(lon, "lon", 6), _r(h, "h", 3))


@query(f"WITH {_POS} SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, round(h, 3) AS h FROM pos")
def enu_round_trip(spark, sf_dir) -> DataFrame:
    origin = (F.lit(48.0), F.lit(11.0), F.lit(500.0))
    lat, lon, h = geodesy.from_enu(*geodesy.to_enu(F.col("lat"), F.col("lon"), F.col("h"), *origin), *origin)
    return _positions(spark, sf_dir).select("id", _r(lat, "lat", 6), _r(lon, "lon", 6), _r(h, "h", 3))


@query(f"WITH {LINKS} SELECT link_id, round(52 + degrees(y / 6378137.0), 8) AS lat, round(9 + degrees(x / (6378137.0 * cos(radians(52.0)))), 8) AS lon FROM links")
def spherical_latlon(spark, sf_dir) -> DataFrame:
    lat, lon = geodesy.xy_to_latlon_spherical(F.col("x"), F.col("y"), F.lit(52.0), F.lit(9.0))
    return fixtures.road_links(spark, sf_dir).select("link_id", _r(lat, "lat", 8), _r(lon, "lon", 8))


_RAW_ID = "CASE c_custkey % 5 WHEN 0 THEN '\"' || c_custkey || '\"' WHEN 1 THEN ' ''' || c_custkey || ''' ' WHEN 2 THEN c_name WHEN 3 THEN c_custkey || '.5' ELSE c_custkey::VARCHAR END"


@query(f"""WITH r AS (SELECT c_custkey AS id, regexp_replace(trim({_RAW_ID}), '^["'']+|["'']+$', '', 'g') AS t FROM customer)
SELECT id, CASE WHEN regexp_full_match(t, '[0-9]+') THEN t::BIGINT END AS number, t AS text FROM r""")
def id_normalisation(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 5 == 0, F.concat(F.lit('"'), k, F.lit('"'))).when(k % 5 == 1, F.concat(F.lit(" '"), k, F.lit("' "))).when(k % 5 == 2, F.col("c_name")).when(k % 5 == 3, F.concat(k, F.lit(".5"))).otherwise(k.cast("string"))
    c = fixtures.table(spark, sf_dir, "customer").select(k.alias("id"), kind.alias("raw"))
    return c.select("id", geodesy.normal_id(F.col("raw")).alias("number"), geodesy.normal_id_text(F.col("raw")).alias("text"))


@query(f"WITH {LINKS} SELECT link_id FROM links WHERE x BETWEEN 1200 AND 7205.5 AND y BETWEEN 400 AND 9600")
def rectangle_filter(spark, sf_dir) -> DataFrame:
    links = fixtures.road_links(spark, sf_dir)
    return links.where(geodesy.in_rectangle(F.col("x"), F.col("y"), 7205.5, 400.0, 1200.0, 9600.0)).select("link_id")


# records and keyed joins

@query("""WITH r AS (SELECT l_orderkey AS link_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS item_no, l_returnflag AS flag, l_linestatus AS direction FROM lineitem)
SELECT link_id, min(item_no)::INT AS item_no, flag, direction FROM r GROUP BY link_id, flag, direction""")
def record_dedup(spark, sf_dir) -> DataFrame:
    l = fixtures.table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    rows = l.select(F.col("l_orderkey").alias("link_id"), n.alias("item_no"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("direction"))
    return attributes.dedup_records(rows, ["link_id"], "item_no")


@query("SELECT l_orderkey AS link_id, string_agg(DISTINCT 'g' || l_partkey % 90, ',' ORDER BY 'g' || l_partkey % 90) AS lane_groups FROM lineitem GROUP BY 1")
def link_lane_groups(spark, sf_dir) -> DataFrame:
    return attributes.bridge_maps(_bridge(spark, sf_dir))[0].select("link_id", text_of("lane_groups"))


@query("SELECT 'g' || l_partkey % 90 AS lane_group_id, count(DISTINCT l_orderkey)::INT AS n_links, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem GROUP BY 1")
def lane_group_links(spark, sf_dir) -> DataFrame:
    return attributes.bridge_maps(_bridge(spark, sf_dir))[1].select("lane_group_id", F.size("links").alias("n_links"), F.get("links", F.lit(0)).alias("first"), F.element_at("links", -1).alias("last"))


def _bridge(spark, sf_dir) -> DataFrame:
    return fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("link_id"), F.concat(F.lit("g"), F.col("l_partkey") % 90).alias("lane_group_id"))


def _summary(spark, sf_dir) -> DataFrame:
    return fixtures.table(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("link_id")).agg(F.min("l_returnflag").alias("kind"), F.max("l_linenumber").cast("int").alias("level"))


_SUM = "s AS (SELECT l_orderkey AS link_id, min(l_returnflag) AS kind, max(l_linenumber)::INT AS level FROM lineitem WHERE l_quantity > 25 GROUP BY 1)"


@query(f"WITH {LINKS}, {_SUM} SELECT link_id, link_type, kind AS kind_routing, level AS level_routing FROM links LEFT JOIN s USING (link_id)")
def links_with_routing(spark, sf_dir) -> DataFrame:
    return attributes.attach_routing(fixtures.road_links(spark, sf_dir).select("link_id", "link_type"), _summary(spark, sf_dir))


@query(f"""WITH {_SUM}, e AS (SELECT c_custkey AS edge_id, c_custkey * k AS link_id, k FROM customer, (VALUES (3), (5), (7)) t(k)),
b AS (SELECT edge_id, arg_min(link_id, k) AS link_id FROM e JOIN s USING (link_id) GROUP BY 1) SELECT c_custkey AS edge_id, b.link_id, kind, level FROM customer LEFT JOIN b ON edge_id = c_custkey LEFT JOIN s USING (link_id)""")
def edge_routing(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    edges = fixtures.table(spark, sf_dir, "customer").select(k.alias("edge_id"), F.array(k * 3, k * 5, k * 7).alias("links"))
    return lanes.edge_attributes(edges, _summary(spark, sf_dir)).select("edge_id", "link_id", "kind", "level")


_ENDS = "e AS (SELECT l_orderkey AS lane_id, CASE WHEN l_linestatus = 'O' THEN 'start' ELSE 'end' END AS endpoint, l_partkey % 300 AS node_id FROM lineitem)"


def _lane_end_nodes(spark, sf_dir) -> DataFrame:
    return fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lane_id"), F.when(F.col("l_linestatus") == "O", "start").otherwise("end").alias("endpoint"), (F.col("l_partkey") % 300).alias("node_id"))


@query(f"""WITH {_ENDS}, p AS (SELECT lane_id, min(node_id) FILTER (endpoint = 'start') AS s, min(node_id) FILTER (endpoint = 'end') AS t FROM e GROUP BY 1)
SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM p WHERE s IS NOT NULL AND t IS NOT NULL""")
def lane_endpoint_pairs(spark, sf_dir) -> DataFrame:
    return lanes.endpoint_pairs(_lane_end_nodes(spark, sf_dir))


@query(f"WITH {_ENDS} SELECT node_id, string_agg(DISTINCT lane_id::VARCHAR, ',' ORDER BY lane_id::VARCHAR) AS lanes, count(*) FILTER (endpoint = 'start') AS n_start, count(*) FILTER (endpoint = 'end') AS n_end FROM e GROUP BY 1")
def node_lanes(spark, sf_dir) -> DataFrame:
    found = lanes.node_lane_lists(_lane_end_nodes(spark, sf_dir))
    return found.select("node_id", F.array_join(F.array_sort(F.transform("lanes", lambda v: v.cast("string"))), ",").alias("lanes"), "n_start", "n_end")


@query("""WITH a AS (SELECT l_orderkey AS lane_group_ref, l_linenumber AS number, min(l_returnflag) AS kind FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS lane_group_ref, (o_custkey % 7)::INT AS number, kind FROM orders LEFT JOIN a ON lane_group_ref = o_orderkey AND number = o_custkey % 7""")
def lanes_with_attributes(spark, sf_dir) -> DataFrame:
    own = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lane_group_ref"), (F.col("o_custkey") % 7).cast("int").alias("number"))
    attrs = fixtures.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").cast("int").alias("lane_no")).agg(F.min("l_returnflag").alias("kind"))
    return lanes.attach_lane_attributes(own, attrs)


@query(f"""WITH {LINKS}, q AS (SELECT p_partkey AS query_id, (p_partkey * 53 % 13000)::DOUBLE AS px, (p_partkey * 97 % 24000)::DOUBLE AS py FROM part WHERE p_partkey % 20 = 0)
SELECT query_id, arg_min(link_id, (dist, link_id)) AS node_id, round(min(dist), 6) AS dist FROM (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS dist FROM q, links) GROUP BY 1""")
def nearest_graph_node(spark, sf_dir) -> DataFrame:
    p = F.col("p_partkey")
    q = fixtures.table(spark, sf_dir, "part").where(p % 20 == 0).select(p.alias("query_id"), (p * 53 % 13000).cast("double").alias("px"), (p * 97 % 24000).cast("double").alias("py"))
    return routing.nearest_node(q, fixtures.road_links(spark, sf_dir).select(F.col("link_id").alias("node_id"), "x", "y")).select("query_id", "node_id", _r("dist", "dist", 6))


# connection points

@query("""WITH a AS (SELECT DISTINCT l_orderkey AS node_id, l_suppkey % 2 AS link_id, l_partkey * 31 % 360 AS angle FROM lineitem),
g AS (SELECT node_id, link_id, coalesce(lead(angle) OVER o, min(angle) OVER (PARTITION BY node_id, link_id) + 360) - angle AS gap, count(*) OVER (PARTITION BY node_id, link_id) AS n FROM a WINDOW o AS (PARTITION BY node_id, link_id ORDER BY angle)),
l AS (SELECT node_id, CASE WHEN max(n) > 1 THEN greatest(count(*) FILTER (gap > 50), 1) ELSE 1 END AS c FROM g GROUP BY node_id, link_id) SELECT node_id, sum(c)::BIGINT AS legs FROM l GROUP BY 1""")
def leg_counts(spark, sf_dir) -> DataFrame:
    l = fixtures.table(spark, sf_dir, "lineitem")
    return points.leg_count(l.select(F.col("l_orderkey").alias("node_id"), (F.col("l_suppkey") % 2).alias("link_id"), (F.col("l_partkey") * 31 % 360).cast("double").alias("angle")))


@query("SELECT c_custkey AS cp_id, CASE WHEN c_custkey % 3 > 0 THEN k END AS lane_no FROM customer, (VALUES (0), (1)) t(k) WHERE k = 0 OR c_custkey % 3 = 2")
def points_per_lane(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    nos = F.when(k % 3 == 1, F.array(F.lit(0))).when(k % 3 == 2, F.array(F.lit(0), F.lit(1)))
    return points.per_lane(fixtures.table(spark, sf_dir, "customer").select(k.alias("cp_id"), nos.alias("lane_nos")))


@query(f"""WITH cp AS (SELECT vec_id AS cp_id, vec_id % 900 AS link_id, CASE WHEN vec_id % 2 = 0 THEN 'start' ELSE 'end' END AS link_end FROM embeddings), {LINKS},
bare AS (SELECT link_id, e AS link_end FROM links, (VALUES ('start'), ('end')) t(e) WHERE NOT EXISTS (SELECT 1 FROM cp WHERE cp.link_id = links.link_id AND cp.link_end = e))
SELECT cp_id, link_id, link_end, false AS synthetic FROM cp UNION ALL
SELECT (SELECT max(cp_id) FROM cp) + row_number() OVER (ORDER BY link_id, link_end), link_id, link_end, true FROM bare""")
def covered_link_ends(spark, sf_dir) -> DataFrame:
    cp = fixtures.connection_points(spark, sf_dir).withColumn("link_id", F.col("cp_id") % 900)
    ends = graphs.incidence(fixtures.road_links(spark, sf_dir)).select("node_id", "link_id", "link_end", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return points.cover_link_ends(cp, ends).select("cp_id", "link_id", "link_end", "synthetic")
