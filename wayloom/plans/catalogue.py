"""Registered queries of the road-graph operators and their SQL twins.

Each query runs an operator over whole tables derived from the driver's
(``sources.fixtures``). Arrays are compared as texts of their sorted elements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import geodesy, polyline, predicate
from wayloom.operators import attributes, dual, graphs, junctions, points, routing, spatial, views
from wayloom.plans import roads
from wayloom.plans.scratch import Scratch
from wayloom.sources import documents, fixtures, synthetic

QUERIES: dict = {}
SQL: dict[str, str] = {}

LINKS = """links AS (
  SELECT o_orderkey AS link_id, o_orderkey AS u, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey + 3 ELSE o_orderkey + 1 END AS v,
    CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 2 WHEN o_orderpriority IN ('3-MEDIUM','4-NOT SPECIFIED') THEN 1 ELSE 0 END AS link_type,
    60.0 * (o_orderkey % 200) + (o_custkey % 20) AS x, 400.0 * floor(o_orderkey / 200) + ((o_custkey * 7) % 30) AS y
  FROM orders)"""
DUAL = LINKS + """, ends AS (
  SELECT link_id, link_type, u AS node FROM links WHERE link_type > 0 UNION SELECT link_id, link_type, v FROM links WHERE link_type > 0),
dual AS (
  SELECT DISTINCT a.link_id AS src, b.link_id AS dst, a.link_type AS st, b.link_type AS dt FROM ends a JOIN ends b ON a.node = b.node AND a.link_id <> b.link_id)"""
REACH = DUAL + """, reach(src, dst) AS (
  SELECT link_id, link_id FROM links WHERE link_type = 2
  UNION SELECT r.src, d.dst FROM reach r JOIN dual d ON r.dst = d.src WHERE d.st = 2 AND d.dt = 2),
comp AS (SELECT src AS link_id, arg_min(dst, dst::VARCHAR) AS component FROM reach GROUP BY 1)"""
CAND = REACH + """, bound AS (
  SELECT DISTINCT c.component, d.dst AS primary_id FROM dual d JOIN comp c ON d.src = c.link_id WHERE d.dt = 1),
acc AS (
  SELECT s.component, n_secondary, n_primary FROM (SELECT component, count(*) AS n_secondary FROM comp GROUP BY 1) s
  JOIN (SELECT component, count(*) AS n_primary FROM bound GROUP BY 1) p ON s.component = p.component WHERE n_secondary >= 2 AND n_primary >= 2),
own AS (SELECT b.* FROM bound b JOIN acc a ON a.component = b.component),
shared AS (SELECT x.component AS a, y.component AS b, count(*) AS n_shared FROM own x JOIN own y ON x.primary_id = y.primary_id AND x.component < y.component GROUP BY 1, 2),
pts AS (
  SELECT c.component, l.link_id, l.x + d.dx AS x, l.y FROM comp c JOIN acc a ON a.component = c.component JOIN links l ON l.link_id = c.link_id, (VALUES (0.0), (60.0)) d(dx)),
mind AS (
  SELECT s.a, s.b, min(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) AS min_dist
  FROM shared s JOIN pts p ON p.component = s.a JOIN pts q ON q.component = s.b GROUP BY 1, 2),
cen AS (SELECT component, avg(x) AS cx, avg(y) AS cy FROM pts GROUP BY 1),
cenpair AS (
  SELECT p.component AS a, q.component AS b, sqrt((p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy)) AS dist
  FROM cen p JOIN cen q ON p.component < q.component AND abs(p.cx - q.cx) <= 300 AND abs(p.cy - q.cy) <= 300),
merge AS (SELECT a, b FROM mind WHERE min_dist <= 50 UNION SELECT a, b FROM cenpair WHERE dist <= 300)"""
MERGED = CAND + """, idx AS (SELECT component, row_number() OVER (ORDER BY component::VARCHAR) AS i FROM acc),
me AS (SELECT DISTINCT least(x.i, y.i) AS i, greatest(x.i, y.i) AS k FROM merge m JOIN idx x ON x.component = m.a JOIN idx y ON y.component = m.b),
und AS (SELECT i AS a, k AS b FROM me UNION SELECT k, i FROM me),
mreach(src, dst) AS (SELECT i, i FROM idx UNION SELECT r.src, m.b FROM mreach r JOIN und m ON r.dst = m.a),
low AS (SELECT src AS i, min(dst) AS lo FROM mreach GROUP BY 1),
ordered AS (SELECT l.lo, e.i, e.k, row_number() OVER (PARTITION BY l.lo ORDER BY e.i, e.k) AS n FROM me e JOIN low l ON l.i = e.i),
united(lo, n, m, r) AS (SELECT lo, 0::BIGINT, list(i ORDER BY i), list(i ORDER BY i) FROM low GROUP BY lo
  UNION ALL SELECT u.lo, o.n, u.m, list_transform(u.r, lambda x: CASE WHEN x = u.r[list_position(u.m, o.k)] THEN u.r[list_position(u.m, o.i)] ELSE x END)
  FROM united u JOIN ordered o ON o.lo = u.lo AND o.n = u.n + 1),
root AS (SELECT lo, arg_max(r, n)[1] AS root FROM united GROUP BY lo),
grp AS (SELECT x.component, s.component AS g FROM low l JOIN idx x ON x.i = l.i JOIN idx s ON s.i = l.lo),
num AS (SELECT s.component AS g, row_number() OVER (ORDER BY root) AS junction_id FROM root JOIN idx s ON s.i = root.lo),
sec AS (SELECT DISTINCT n.junction_id, n.g, c.link_id FROM comp c JOIN grp g ON g.component = c.component JOIN num n ON n.g = g.g),
pri AS (SELECT DISTINCT n.junction_id, b.primary_id AS link_id FROM bound b JOIN grp g ON g.component = b.component JOIN num n ON n.g = g.g)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return keep


def text_of(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)


def _detect(spark: SparkSession, sf_dir: str) -> junctions.Detection:
    links = fixtures.road_links(spark, sf_dir)
    return junctions.detect(spark, links, fixtures.link_points(links))


# links and the dual graph

@query(f"WITH {LINKS} SELECT link_id, link_type FROM links")
def classify_links(spark, sf_dir) -> DataFrame:
    links = fixtures.road_links(spark, sf_dir)
    kind = lambda n: links.where(F.col("link_type") == n)
    return dual.link_types(links, kind(2), kind(1)).select("link_id", "link_type")


@query(f"WITH {LINKS} SELECT link_type, count(*) AS n_links FROM links GROUP BY 1")
def link_type_counts(spark, sf_dir) -> DataFrame:
    return dual.type_counts(fixtures.road_links(spark, sf_dir))


@query(f"WITH {DUAL} SELECT src, dst FROM dual")
def dual_edges(spark, sf_dir) -> DataFrame:
    return dual.dual_edges(fixtures.road_links(spark, sf_dir))


@query(f"""WITH {DUAL}, near AS (SELECT src, count(*) AS degree, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbours FROM dual GROUP BY 1)
SELECT l.link_id, coalesce(n.degree, 0) AS degree, coalesce(n.neighbours, '') AS neighbours,
  coalesce(sum(coalesce(n.degree, 0)) OVER (ORDER BY l.link_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_offset
FROM links l LEFT JOIN near n ON n.src = l.link_id WHERE l.link_type > 0""")
def csr_rows(spark, sf_dir) -> DataFrame:
    links = fixtures.road_links(spark, sf_dir)
    return dual.csr_rows(dual.dual_edges(links), dual.classified(links)).select("link_id", "degree", text_of("neighbours"), "row_offset")


@query(f"WITH {LINKS} SELECT link_id, row_number() OVER (ORDER BY link_id::VARCHAR) - 1 AS idx FROM links WHERE link_type > 0")
def dense_index(spark, sf_dir) -> DataFrame:
    return dual.dense_index(fixtures.road_links(spark, sf_dir), Scratch(spark, "index")).select("link_id", "idx")


# components, candidates and merging

@query(f"WITH RECURSIVE {REACH} SELECT link_id, component FROM comp")
def secondary_components(spark, sf_dir) -> DataFrame:
    return junctions.secondary_components(spark, fixtures.road_links(spark, sf_dir), Scratch(spark, "components"))


@query(f"WITH RECURSIVE {CAND} SELECT component, primary_id FROM bound")
def component_boundary(spark, sf_dir) -> DataFrame:
    return _detect_to_accepted(spark, sf_dir)[2]


def _detect_to_accepted(spark, sf_dir):
    scratch = Scratch(spark, "candidates")
    links = fixtures.road_links(spark, sf_dir)
    comp = scratch.cut(junctions.secondary_components(spark, links, scratch), "components")
    bound = scratch.cut(junctions.component_boundary(links, comp), "boundary")
    acc = scratch.cut(junctions.candidates(comp, bound), "accepted")
    points_ = junctions.member_points(comp, acc, fixtures.link_points(links))
    return links, comp, bound, acc, points_


@query(f"WITH RECURSIVE {CAND} SELECT component, n_secondary, n_primary, row_number() OVER (ORDER BY component::VARCHAR) AS junction_id FROM acc")
def junction_candidates(spark, sf_dir) -> DataFrame:
    from wayloom.plans.numbering import number_rows

    acc = _detect_to_accepted(spark, sf_dir)[3]
    return number_rows(acc, [F.col("component").cast("string")], "junction_id", Scratch(spark, "numbers")).select("component", "n_secondary", "n_primary", "junction_id")


@query(f"WITH RECURSIVE {CAND} SELECT a, b, n_shared FROM shared")
def shared_primary_pairs(spark, sf_dir) -> DataFrame:
    _, _, bound, acc, _ = _detect_to_accepted(spark, sf_dir)
    return junctions.shared_primary_pairs(acc, bound)


@query(f"WITH RECURSIVE {CAND} SELECT a, b, round(min_dist, 6) AS min_dist FROM mind WHERE min_dist <= 50")
def secondary_min_distance(spark, sf_dir) -> DataFrame:
    _, _, bound, acc, pts = _detect_to_accepted(spark, sf_dir)
    near = junctions.min_distances(junctions.shared_primary_pairs(acc, bound).select("a", "b"), pts, 50.0)
    return near.select("a", "b", F.round("min_dist", 6).alias("min_dist"))


@query(f"WITH RECURSIVE {CAND} SELECT component, round(cx, 6) AS cx, round(cy, 6) AS cy FROM cen")
def candidate_centroids(spark, sf_dir) -> DataFrame:
    return junctions.centroids(_detect_to_accepted(spark, sf_dir)[4]).select("component", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(f"WITH RECURSIVE {CAND} SELECT a, b, round(dist, 6) AS dist FROM cenpair WHERE dist <= 300")
def centroid_pairs(spark, sf_dir) -> DataFrame:
    centres = junctions.centroids(_detect_to_accepted(spark, sf_dir)[4])
    return junctions.centroid_pairs(centres, 300.0).select("a", "b", F.round("dist", 6).alias("dist"))


@query(f"WITH RECURSIVE {CAND} SELECT a, b FROM merge")
def merge_edges(spark, sf_dir) -> DataFrame:
    return _detect(spark, sf_dir).edges


@query(f"""WITH RECURSIVE {MERGED} SELECT n.junction_id, n.g AS seed_link_id,
  (SELECT string_agg(link_id::VARCHAR, ',' ORDER BY link_id) FROM sec s WHERE s.junction_id = n.junction_id) AS secondary_ids,
  (SELECT string_agg(link_id::VARCHAR, ',' ORDER BY link_id) FROM pri p WHERE p.junction_id = n.junction_id) AS primary_ids FROM num n""")
def merged_junctions(spark, sf_dir) -> DataFrame:
    return _detect(spark, sf_dir).junctions.select("junction_id", "seed_link_id", text_of("secondary_ids"), text_of("primary_ids"))


@query(f"""WITH RECURSIVE {MERGED}, roles AS (SELECT junction_id, link_id, min(r) AS r FROM (SELECT junction_id, link_id, 1 AS r FROM sec UNION ALL SELECT junction_id, link_id, 2 FROM pri) GROUP BY 1, 2)
SELECT junction_id, link_id, CASE r WHEN 1 THEN 'ramp' ELSE 'main' END AS role, 2 * link_id AS u, 2 * link_id + 1 AS v FROM roles""")
def junction_edges_roles(spark, sf_dir) -> DataFrame:
    return junctions.link_roles(_detect(spark, sf_dir).junctions)


@query(f"""WITH RECURSIVE {MERGED} SELECT (SELECT count(*) FROM links WHERE link_type > 0) AS roads, (SELECT count(*) FROM links WHERE link_type = 2) AS secondary,
  (SELECT count(*) FROM links WHERE link_type = 1) AS primary_links, (SELECT count(*) FROM dual) AS directed_edges, (SELECT count(*) FROM num) AS junctions""")
def report_row(spark, sf_dir) -> DataFrame:
    links = fixtures.road_links(spark, sf_dir)
    return junctions.report_row(links, dual.dual_edges(links), _detect(spark, sf_dir).junctions)


@query(f"""WITH RECURSIVE {CAND}, h1 AS (SELECT component, primary_id FROM bound UNION SELECT b.component, d.dst FROM bound b JOIN dual d ON d.src = b.primary_id WHERE d.dt = 1)
SELECT component, primary_id FROM h1 UNION SELECT b.component, d.dst FROM h1 b JOIN dual d ON d.src = b.primary_id WHERE d.dt = 1""")
def primary_within_hops(spark, sf_dir) -> DataFrame:
    links, _, bound, _, _ = _detect_to_accepted(spark, sf_dir)
    return junctions.primaries_within_hops(bound, links, 2)


@query(f"WITH {LINKS} SELECT link_id, x AS x0, y AS y0, x + 60 AS x1, y AS y1, 2 * link_id AS u, 2 * link_id + 1 AS v FROM links")
def background_links(spark, sf_dir) -> DataFrame:
    links = fixtures.road_links(spark, sf_dir)
    return documents.background_edges(documents.with_points(links, fixtures.link_points(links)))


def _graph_document(spark, sf_dir) -> DataFrame:
    """The whole graph document in parts, written as text and read again; the classified links' own line is at its points, the background has all links."""
    links = documents.with_points(fixtures.road_links(spark, sf_dir), fixtures.link_points(fixtures.road_links(spark, sf_dir)))
    scratch = Scratch(spark, "document")
    made = documents.graph_document_parts(roads.graph_rows(links, scratch), "config", links.select("link_id", "points"), scratch=scratch)
    return scratch.cut(made, "read")


@query(f"""WITH {DUAL}, idx AS (SELECT link_id, link_type, x, y, row_number() OVER (ORDER BY link_id::VARCHAR) - 1 AS idx FROM links WHERE link_type > 0),
near AS (SELECT d.src, count(*) AS degree, string_agg(i.idx::VARCHAR, ',' ORDER BY i.idx) AS neighbours FROM dual d JOIN idx i ON i.link_id = d.dst GROUP BY 1)
SELECT i.idx::INTEGER AS idx, i.link_id, i.link_type, coalesce(sum(n.degree) OVER (ORDER BY i.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS row_offset,
  coalesce(n.neighbours, '') AS neighbours, (2 * i.idx)::INTEGER AS point_offset, i.x AS x0, i.y AS y0, i.x + 60 AS x1, i.y AS y1
FROM idx i LEFT JOIN near n ON n.src = i.link_id""")
def graph_document_rows(spark, sf_dir) -> DataFrame:
    rows = documents.graph_rows_of_parts(_graph_document(spark, sf_dir))
    return rows.withColumn("neighbours", F.array_join(F.transform("neighbours", lambda v: v.cast("string")), ","))


@query(f"""WITH {LINKS} SELECT link_id, (2 * (row_number() OVER (ORDER BY link_id) - 1))::INTEGER AS point_offset, x AS x0, y AS y0, x + 60 AS x1, y AS y1 FROM links""")
def background_document_rows(spark, sf_dir) -> DataFrame:
    """The document's background arrays, written as text in parts and read again; its other arrays have no part in them."""
    scratch = Scratch(spark, "background")
    lines = scratch.cut(fixtures.road_lines(spark, sf_dir), "lines")
    return documents.background_rows_of_parts(documents.background_parts(lines, scratch))


@query(f"""WITH {LINKS} SELECT link_id + r * 1000000000000 AS link_id, u + r * 1000000000000 AS u, v + r * 1000000000000 AS v, link_type,
  x + 100000.0 * (r % 10) AS x, y + 100000.0 * floor(r / 10) AS y FROM links, range(12) t(r)""")
def synthetic_multiply(spark, sf_dir) -> DataFrame:
    return synthetic.multiply(fixtures.road_links(spark, sf_dir), 12).drop("repeat")


# decoding and geodesy

@query("""WITH c AS (SELECT o_orderkey AS id, o_orderkey * 97561234567 AS code FROM orders),
b AS (SELECT id, list_sum(list_transform(range(0, 32), lambda i: ((code >> (2 * i)) & 1) * (1::BIGINT << i)))::BIGINT AS lon, list_sum(list_transform(range(0, 31), lambda i: ((code >> (2 * i + 1)) & 1) * (1::BIGINT << i)))::BIGINT AS lat FROM c)
SELECT id, round(CASE WHEN lat >= 1073741824 THEN lat - 2147483648 ELSE lat END * 180.0::DOUBLE / 2147483648, 7) AS lat,
  round(CASE WHEN lon >= 2147483648 THEN lon - 4294967296 ELSE lon END * 180.0::DOUBLE / 2147483648, 7) AS lon FROM b""")
def morton_decode(spark, sf_dir) -> DataFrame:
    codes = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), geodesy.parse_uint64((F.col("o_orderkey") * 97561234567).cast("string")).alias("code"))
    return codes.select("id", F.round(geodesy.morton_lat(F.col("code")), 7).alias("lat"), F.round(geodesy.morton_lon(F.col("code")), 7).alias("lon"))


@query("""WITH s AS (SELECT l_orderkey AS id, l_partkey AS d, row_number() OVER w AS pos FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate)),
p AS (SELECT a.id, a.pos, bit_xor(b.d) AS x FROM s a JOIN s b ON a.id = b.id AND b.pos <= a.pos GROUP BY 1, 2)
SELECT id, pos, xor(x, id) AS code FROM p""")
def xor_stream_decode(spark, sf_dir) -> DataFrame:
    from pyspark.sql.window import Window

    l = fixtures.table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    s = l.withColumn("pos", F.row_number().over(order)).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("l_partkey").alias("d")))).alias("z"))
    s = s.select("id", geodesy.xor_stream(F.col("id"), F.transform("z", lambda z: z["d"])).alias("codes"))
    return s.select("id", F.posexplode("codes").alias("pos", "code")).select("id", (F.col("pos") + 1).alias("pos"), "code")


_ECEF = lambda t, lat, lon: f"""{t}0 AS (SELECT id, radians({lat}) AS p, radians({lon}) AS q, 6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(radians({lat})) * sin(radians({lat}))) AS n FROM pos),
{t} AS (SELECT id, n * cos(p) * cos(q) AS x, n * cos(p) * sin(q) AS y, n * (1 - 0.0066943799901413165) * sin(p) AS z FROM {t}0)"""  # noqa: E731


@query(f"""WITH pos AS (SELECT c_custkey AS id, 52 + (c_custkey % 1000) / 10000.0::DOUBLE AS lat, 9 + c_nationkey / 100.0::DOUBLE AS lon FROM customer),
{_ECEF('a', 'lat', 'lon')}, {_ECEF('o', '52.0::DOUBLE', '9.0::DOUBLE')}
SELECT id, round(-sin(radians(9.0)) * (a.x - o.x) + cos(radians(9.0)) * (a.y - o.y), 4) AS east,
  round(-sin(radians(52.0)) * cos(radians(9.0)) * (a.x - o.x) - sin(radians(52.0)) * sin(radians(9.0)) * (a.y - o.y) + cos(radians(52.0)) * (a.z - o.z), 4) AS north
FROM a JOIN o USING (id)""")
def geodetic_to_enu(spark, sf_dir) -> DataFrame:
    c = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.lit(52.0) + (F.col("c_custkey") % 1000) / 10000).alias("lat"), (F.lit(9.0) + F.col("c_nationkey") / 100).alias("lon"))
    e, n, _ = geodesy.to_enu(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(52.0), F.lit(9.0), F.lit(0.0))
    return c.select("id", F.round(e, 4).alias("east"), F.round(n, 4).alias("north"))


@query("""SELECT min(52 + (c_custkey % 1000) / 10000.0::DOUBLE) AS min_lat, max(52 + (c_custkey % 1000) / 10000.0::DOUBLE) AS max_lat,
  min(9 + c_nationkey / 100.0::DOUBLE) AS min_lon, max(9 + c_nationkey / 100.0::DOUBLE) AS max_lon FROM customer""")
def bounding_box(spark, sf_dir) -> DataFrame:
    c = fixtures.table(spark, sf_dir, "customer").select((F.lit(52.0) + (F.col("c_custkey") % 1000) / 10000).alias("lat"), (F.lit(9.0) + F.col("c_nationkey") / 100).alias("lon"))
    return geodesy.bounding_box(c)


# attributes

_IV = """iv AS (SELECT l_orderkey AS group_id, l_returnflag AS dir, least(greatest((l_partkey % 100) / 100.0::DOUBLE, 0), 1) AS s0, least(greatest((l_partkey % 100) / 100.0::DOUBLE + l_quantity / 200, 0), 1) AS s1 FROM lineitem)"""


@query(f"""WITH {_IV}, m AS (SELECT *, max(s1) OVER (PARTITION BY group_id, dir ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv WHERE s1 - s0 > 1e-12),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s0 > reach + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY group_id, dir ORDER BY s0, s1 ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT group_id, dir, round(min(s0), 6) AS s0, round(max(s1), 6) AS s1 FROM i GROUP BY group_id, dir, island""")
def interval_coalesce(spark, sf_dir) -> DataFrame:
    out = attributes.coalesce_intervals(fixtures.intervals(spark, sf_dir), ["group_id", "dir"])
    return out.select("group_id", "dir", F.round("s0", 6).alias("s0"), F.round("s1", 6).alias("s1"))


@query("""WITH r AS (SELECT l_orderkey AS id, l_partkey % 13 AS k, (l_partkey % 100) / 100.0::DOUBLE AS a, (l_suppkey % 100) / 100.0::DOUBLE AS b FROM lineitem),
n AS (SELECT *, CASE WHEN k < 5 THEN a WHEN k < 9 THEN a ELSE 0 END AS lo, CASE WHEN k < 5 THEN b WHEN k < 9 THEN 1 WHEN k < 12 THEN 1 - b ELSE 1 END AS hi FROM r)
SELECT id, CASE WHEN hi > lo THEN round(lo, 6) ELSE 0 END AS s0, CASE WHEN hi > lo THEN round(hi, 6) ELSE 1 END AS s1, count(*) AS n FROM n GROUP BY 1, 2, 3""")
def range_normalise(spark, sf_dir) -> DataFrame:
    l = fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 13).alias("k"), ((F.col("l_partkey") % 100) / 100).alias("a"), ((F.col("l_suppkey") % 100) / 100).alias("b"))
    k = F.col("k")
    r = attributes.range_of(F.when(k < 5, F.col("a")), F.when(k < 5, F.col("b")), F.when((k >= 5) & (k < 9), F.col("a")), F.when((k >= 9) & (k < 12), F.col("b")))
    return l.select("id", r.alias("r")).groupBy("id", F.round("r.s0", 6).alias("s0"), F.round("r.s1", 6).alias("s1")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey AS group_id, l_linenumber AS lane_no, CASE WHEN bool_or(l_linestatus = 'O') AND bool_or(l_linestatus = 'F') THEN 'BOTH' WHEN bool_or(l_linestatus = 'O') THEN 'FWD'
  WHEN bool_or(l_linestatus = 'F') THEN 'BWD' ELSE 'NONE' END AS allowed FROM lineitem GROUP BY 1, 2""")
def lane_direction_summary(spark, sf_dir) -> DataFrame:
    l = fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("lane_no"), F.when(F.col("l_linestatus") == "O", "FORWARD").otherwise("BACKWARD").alias("direction"))
    return attributes.direction_summary(l, ["group_id", "lane_no"])


@query("""WITH g AS (SELECT o_orderkey AS group_id FROM orders), r AS (SELECT l_orderkey AS group_id, bool_or(l_returnflag = 'R') AS f, bool_or(l_returnflag = 'A') AS b FROM lineitem GROUP BY 1)
SELECT g.group_id, CASE WHEN r.group_id IS NULL THEN 'UNKNOWN' WHEN f AND b THEN 'BOTH' WHEN f THEN 'FWD' WHEN b THEN 'BWD' ELSE 'NONE' END AS allowed FROM g LEFT JOIN r ON r.group_id = g.group_id""")
def group_direction_summary(spark, sf_dir) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.when(F.col("l_returnflag") == "R", "FORWARD").when(F.col("l_returnflag") == "A", "BACKWARD").alias("direction"))
    return attributes.group_directions(fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id")), rows)


@query("""SELECT l_orderkey AS group_id, l_linenumber AS lane_no, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS directions, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS types,
  bool_or(l_tax > 0.07) AS in_intersection, count(*) AS n_ranges FROM lineitem GROUP BY 1, 2""")
def lane_attribute_merge(spark, sf_dir) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("lane_no"), F.col("l_linestatus").alias("direction"), F.col("l_returnflag").alias("lane_type"),
                                                            F.lit(None).cast("string").alias("width_profile"), (F.col("l_tax") > 0.07).alias("in_intersection"))
    return attributes.lane_attributes(rows).select("group_id", "lane_no", text_of("directions"), text_of("types"), "in_intersection", "n_ranges")


_ITEMS = """items AS (SELECT l_orderkey AS link_id, l_linenumber AS item_no, l_returnflag = 'R' AS is_ramp, 'FC_' || (1 + l_linenumber % 5) AS fc FROM lineitem)"""
PREDICATE = 'is_ramp == true and not (functional_class == "FC_1")'


def _values(spark, sf_dir) -> DataFrame:
    return predicate.item_values(fixtures.attribute_items(spark, sf_dir), {"is_ramp": "boolean", "functional_class": "string"})


@query(f"""WITH {_ITEMS} SELECT link_id FROM items GROUP BY 1 HAVING bool_and(is_ramp) AND NOT (count(DISTINCT fc) = 1 AND min(fc) = 'FC_1')""")
def attr_query_union(spark, sf_dir) -> DataFrame:
    return predicate.select_links(_values(spark, sf_dir), PREDICATE)


@query(f"""WITH {_ITEMS}, per AS (SELECT link_id, item_no, bool_and(is_ramp) AS r, count(DISTINCT fc) AS n, min(fc) AS fc FROM items GROUP BY 1, 2)
SELECT DISTINCT link_id FROM per WHERE r AND NOT (n = 1 AND fc = 'FC_1')""")
def attr_query_any_item(spark, sf_dir) -> DataFrame:
    return predicate.select_links(_values(spark, sf_dir), PREDICATE, "any_item")


@query("""WITH i AS (SELECT l_orderkey AS link_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS n, * FROM lineitem),
s AS (SELECT *, 2 * (l_linestatus = 'O')::INT + (l_partkey % 2)::INT AS r FROM i)
SELECT link_id, arg_max('FC_' || (1 + l_linenumber % 5), (r, -n)) AS functional_class, bool_or(l_returnflag = 'R') AS is_ramp FROM s GROUP BY 1""")
def routing_summary(spark, sf_dir) -> DataFrame:
    from pyspark.sql.window import Window

    l = fixtures.table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    items = l.select(F.col("l_orderkey").alias("link_id"), n.alias("item_no"), F.when(F.col("l_linestatus") == "O", "BOTH").otherwise("FORWARD").alias("direction"), (F.col("l_partkey") % 2 == 0).alias("has_range"),
                     F.concat(F.lit("FC_"), (F.col("l_linenumber") % 5 + 1).cast("string")).alias("functional_class"), (F.col("l_returnflag") == "R").alias("is_ramp"))
    return attributes.routing_summary(items).select("link_id", "functional_class", "is_ramp")


# node and lane graphs

@query("""SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n_points FROM (SELECT c_custkey % 1000 AS x, c_nationkey AS y FROM customer) GROUP BY round_even(x / 8.0, 0), round_even(y / 8.0, 0)""")
def grid_dedup_nodes(spark, sf_dir) -> DataFrame:
    c = fixtures.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 1000).cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return graphs.grid_nodes(c, 8.0).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n_points")


_INC = LINKS + """, inc AS (SELECT u AS node_id, link_id, 'start' AS link_end FROM links UNION ALL SELECT v, link_id, 'end' FROM links)"""


@query(f"""WITH {_INC} SELECT node_id, count(*) FILTER (link_end = 'start') AS n_start, count(*) FILTER (link_end = 'end') AS n_end, string_agg(DISTINCT link_id::VARCHAR, ',' ORDER BY link_id::VARCHAR) AS links FROM inc GROUP BY 1""")
def node_incidence_lists(spark, sf_dir) -> DataFrame:
    n = graphs.node_lists(fixtures.road_links(spark, sf_dir))
    return n.select("node_id", "n_start", "n_end", F.array_join(F.array_sort(F.transform("links", lambda v: v.cast("string"))), ",").alias("links"))


@query(f"""WITH {LINKS}, b AS (SELECT u AS node_id, v AS other FROM links UNION SELECT v, u FROM links) SELECT node_id, count(*) AS degree FROM b WHERE node_id <> other GROUP BY 1 HAVING count(*) >= 3""")
def link_degree_seeds(spark, sf_dir) -> DataFrame:
    return graphs.degree_seeds(fixtures.road_links(spark, sf_dir), 3).select("node_id", "degree")


_CLS = _INC + """, cls AS (SELECT node_id, count(*) AS n_ends, count(DISTINCT inc.link_id) AS n_links FROM inc JOIN links USING (link_id) WHERE link_type > 0 GROUP BY 1),
nc AS (SELECT *, CASE WHEN n_ends >= 3 THEN 'junction' WHEN n_ends = 2 AND n_links = 2 THEN 'chain' WHEN n_ends = 1 THEN 'dead_end' ELSE 'none' END AS node_class FROM cls)"""


@query(f"WITH {_CLS} SELECT * FROM nc")
def link_end_classification(spark, sf_dir) -> DataFrame:
    links = fixtures.road_links(spark, sf_dir)
    return graphs.classify_nodes(links, dual.classified(links))


@query("""WITH s AS (SELECT o_orderkey AS link_id, o_custkey % 700 AS u, 700 + o_orderkey % 900 AS v, o_orderpriority <> '5-LOW' AS laned FROM orders),
n AS (SELECT node_id FROM (SELECT u AS node_id FROM s WHERE laned UNION ALL SELECT v FROM s WHERE laned) GROUP BY 1 HAVING count(*) >= 3)
SELECT link_id, u, v FROM s WHERE u IN (SELECT node_id FROM n) AND v IN (SELECT node_id FROM n)""")
def junction_graph(spark, sf_dir) -> DataFrame:
    streets = fixtures.streets(spark, sf_dir)
    return graphs.junction_graph(streets, graphs.classify_nodes(streets, streets.where("laned")))


@query("""SELECT o_orderkey AS link_id, link_end FROM orders, (VALUES ('start'), ('end')) e(link_end)
EXCEPT SELECT l_orderkey, CASE WHEN l_linestatus = 'O' THEN 'start' ELSE 'end' END FROM lineitem WHERE l_quantity > 25""")
def missing_link_ends(spark, sf_dir) -> DataFrame:
    links = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("link_id"))
    seen = fixtures.table(spark, sf_dir, "lineitem").where("l_quantity > 25")
    return graphs.missing_link_ends(seen.select(F.col("l_orderkey").alias("link_id"), F.when(F.col("l_linestatus") == "O", "start").otherwise("end").alias("link_end")), links)


_G = """g AS (SELECT o_orderkey AS group_id, o_custkey AS from_id, o_orderkey % 1000 AS to_id, (o_custkey % 100)::DOUBLE AS fx, (o_custkey % 37)::DOUBLE AS fy, (o_orderkey % 100)::DOUBLE AS tx, (o_orderkey % 41)::DOUBLE AS ty,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 50)::DOUBLE END AS topo_len, CASE WHEN o_orderkey % 2 = 0 THEN (1 + o_custkey % 60)::DOUBLE END AS poly_len,
  CASE o_orderkey % 5 WHEN 0 THEN 'BOTH' WHEN 1 THEN 'FWD' WHEN 2 THEN 'BWD' WHEN 3 THEN 'UNKNOWN' ELSE 'NONE' END AS allowed FROM orders),
w AS (SELECT *, CASE WHEN topo_len > 0 THEN topo_len WHEN poly_len > 0 THEN poly_len ELSE sqrt((tx - fx) * (tx - fx) + (ty - fy) * (ty - fy)) END AS weight FROM g)"""


@query(f"""WITH {_G} SELECT group_id, from_id AS src, to_id AS dst, round(weight, 6) AS weight FROM w WHERE allowed IN ('BOTH','FWD','UNKNOWN')
UNION ALL SELECT group_id, to_id, from_id, round(weight, 6) FROM w WHERE allowed IN ('BOTH','BWD','UNKNOWN')""")
def connector_edges(spark, sf_dir) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    m = o % 5
    g = fixtures.table(spark, sf_dir, "orders").select(
        o.alias("group_id"), c.alias("from_id"), (o % 1000).alias("to_id"), *[e.cast("double").alias(n) for n, e in (("fx", c % 100), ("fy", c % 37), ("tx", o % 100), ("ty", o % 41))],
        F.when(o % 3 == 0, (o % 50).cast("double")).alias("topo_len"), F.when(o % 2 == 0, (1 + c % 60).cast("double")).alias("poly_len"),
        F.when(m == 0, "BOTH").when(m == 1, "FWD").when(m == 2, "BWD").when(m == 3, "UNKNOWN").otherwise("NONE").alias("allowed"))
    return graphs.connector_graph(g, undirected=True)[2].withColumn("weight", F.round("weight", 6))


@query("""WITH l AS (SELECT c_custkey AS lane_id, (c_custkey % 10)::DOUBLE AS sx, (c_custkey % 7)::DOUBLE AS sy, (c_custkey % 9)::DOUBLE AS ex, c_nationkey::DOUBLE AS ey, c_custkey % 3 AS k FROM customer),
n AS (SELECT x, y, row_number() OVER (ORDER BY x, y) - 1 AS node_id FROM (SELECT sx AS x, sy AS y FROM l UNION SELECT ex, ey FROM l)),
e AS (SELECT lane_id, 'FORWARD' AS dir, a.node_id AS src, b.node_id AS dst, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) AS weight FROM l JOIN n a ON a.x = sx AND a.y = sy JOIN n b ON b.x = ex AND b.y = ey WHERE k > 0
  UNION ALL SELECT lane_id, 'BACKWARD', b.node_id, a.node_id, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) FROM l JOIN n a ON a.x = sx AND a.y = sy JOIN n b ON b.x = ex AND b.y = ey WHERE k > 1)
SELECT src, dst, arg_max(lane_id, (lane_id, dir)) AS lane_id, arg_max(dir, (lane_id, dir)) AS dir, round(arg_max(weight, (lane_id, dir)), 6) AS weight FROM e GROUP BY 1, 2""")
def lane_graph_edges(spark, sf_dir) -> DataFrame:
    c = fixtures.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    dirs = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("FORWARD"))).otherwise(F.array(F.lit("FORWARD"), F.lit("BACKWARD")))
    lanes = c.select(k.alias("lane_id"), dirs.alias("dirs"), *[e.cast("double").alias(n) for n, e in (("sx", k % 10), ("sy", k % 7), ("ex", k % 9), ("ey", F.col("c_nationkey")))])
    return graphs.lane_graph(lanes)[1].withColumn("weight", F.round("weight", 6))


_SP = """e AS (SELECT o_orderkey AS src, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey + 3 ELSE o_orderkey + 1 END AS dst, 1 + o_custkey % 9 AS w FROM orders)"""


@query(f"""WITH RECURSIVE {_SP}, walk(node, dist, source) AS (SELECT o_orderkey, 0::BIGINT, o_orderkey FROM orders WHERE o_orderkey % 100 = 0
  UNION SELECT e.dst, (k.dist + e.w)::BIGINT, k.source FROM walk k JOIN e ON e.src = k.node WHERE k.dist + e.w <= 40)
SELECT node, min(dist)::DOUBLE AS dist FROM walk GROUP BY 1""")
def shortest_path_lengths(spark, sf_dir) -> DataFrame:
    o = fixtures.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    edges = o.select(k.alias("src"), F.when(k % 7 == 0, k + 3).otherwise(k + 1).alias("dst"), (1 + F.col("o_custkey") % 9).alias("weight"))
    starts = o.where(k % 100 == 0).select(k.alias("node"))
    return graphs.shortest_paths(spark, edges, starts, max_cost=40.0).select("node", "dist")


@query(f"""WITH {_SP} SELECT node FROM (SELECT src AS node, dst AS o FROM e UNION SELECT dst, src FROM e) WHERE node <> o GROUP BY 1 HAVING count(*) = 1""")
def leaf_nodes(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return graphs.leaf_nodes(fixtures.table(spark, sf_dir, "orders").select(k.alias("src"), F.when(k % 7 == 0, k + 3).otherwise(k + 1).alias("dst")))


# nearest neighbours and projections

@query(f"""WITH {LINKS}, q AS (SELECT p_partkey AS q_id, (p_partkey * 37 % 12000)::DOUBLE AS qx, (p_partkey * 91 % 20000)::DOUBLE AS qy FROM part WHERE p_partkey % 20 = 0),
d AS (SELECT q_id, link_id AS p_id, sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) AS dist FROM q, links),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, p_id) AS rank FROM d) SELECT q_id, p_id, round(dist, 6) AS dist, rank FROM r WHERE rank <= 3""")
def knn_lanes(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    q = fixtures.table(spark, sf_dir, "part").where(k % 20 == 0).select(k.alias("q_id"), (k * 37 % 12000).cast("double").alias("qx"), (k * 91 % 20000).cast("double").alias("qy"))
    p = fixtures.road_links(spark, sf_dir).select(F.col("link_id").alias("p_id"), "x", "y")
    return spatial.k_nearest(q, p, 3, 400.0).select("q_id", "p_id", F.round("dist", 6).alias("dist"), "rank")


@query(f"""WITH {LINKS}, l AS (SELECT link_id, x AS ax, y AS ay, x + 60 AS bx, y + 30 AS byy FROM links),
p AS (SELECT *, x0 AS px, y0 AS py FROM l JOIN (SELECT link_id AS q_id, x + (link_id % 90) - 15 AS x0, y + (link_id % 50) AS y0 FROM links) q ON q.q_id = l.link_id),
t AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (byy - ay)) / ((bx - ax) * (bx - ax) + (byy - ay) * (byy - ay)))) AS t FROM p)
SELECT q_id, link_id AS line_id, round(sqrt((px - ax - t * (bx - ax)) ** 2 + (py - ay - t * (byy - ay)) ** 2), 6) AS dist, round(t, 6) AS frac FROM t""")
def point_polyline_projection(spark, sf_dir) -> DataFrame:
    links = fixtures.road_links(spark, sf_dir)
    lines = links.select(F.col("link_id").alias("line_id"), F.array(F.struct("x", "y"), F.struct((F.col("x") + 30).alias("x"), (F.col("y") + 15).alias("y")), F.struct((F.col("x") + 60).alias("x"), (F.col("y") + 30).alias("y"))).alias("points"))
    q = links.select(F.col("link_id").alias("q_id"), (F.col("x") + F.col("link_id") % 90 - 15).alias("px"), (F.col("y") + F.col("link_id") % 50).alias("py"))
    pairs = q.join(spatial.segments(lines), F.col("q_id") == F.col("line_id"))
    return spatial.project_points(pairs, "q_id").select("q_id", "line_id", F.round("dist", 6).alias("dist"), F.round("frac", 6).alias("frac"))


_SNAP = f"""WITH {LINKS}, l AS (SELECT link_id, x AS ax, y AS ay, x + 60 AS bx, y + 30 AS byy FROM links),
q AS (SELECT p_partkey AS query_id, (p_partkey * 37 % 14000)::DOUBLE AS px, (p_partkey * 91 % 25000)::DOUBLE AS py FROM part WHERE p_partkey % 20 = 0),
t AS (SELECT *, greatest(0, least(1, ((px - ax) * 60 + (py - ay) * 30) / 4500.0)) AS t FROM q, l),
d AS (SELECT *, sqrt((px - ax - t * 60) ** 2 + (py - ay - t * 30) ** 2) AS dist FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, link_id) AS rank FROM d)
SELECT query_id, link_id AS lane_id, round(dist, 6) AS dist, round(t, 6) AS frac, rank FROM r WHERE rank <= {{k}}"""


def _snapped(spark, sf_dir, k: int) -> DataFrame:
    links, p = fixtures.road_links(spark, sf_dir), F.col("p_partkey")
    lines = links.select(F.col("link_id").alias("line_id"), F.array(F.struct("x", "y"), F.struct((F.col("x") + 60).alias("x"), (F.col("y") + 30).alias("y"))).alias("points"))
    q = fixtures.table(spark, sf_dir, "part").where(p % 20 == 0).select(p.alias("query_id"), (p * 37 % 14000).cast("double").alias("px"), (p * 91 % 25000).cast("double").alias("py"))
    return routing.snap_to_lanes(q, lines, k).select("query_id", "lane_id", F.round("dist", 6).alias("dist"), F.round("frac", 6).alias("frac"), "rank")


@query(_SNAP.format(k=1))
def snap_nearest_lane(spark, sf_dir) -> DataFrame:
    return _snapped(spark, sf_dir, 1)


@query(_SNAP.format(k=4))
def snap_closest_lanes(spark, sf_dir) -> DataFrame:
    return _snapped(spark, sf_dir, 4)


# connection points

_CP = """cp AS (SELECT vec_id AS cp_id, label::BIGINT AS node_id, vec_id % 7 AS link_id, CASE WHEN vec_id % 2 = 0 THEN 'start' ELSE 'end' END AS link_end, floor(embedding[1]::DOUBLE * 100) AS x, floor(embedding[2]::DOUBLE * 100) AS y,
  (vec_id * 13 % 25)::DOUBLE AS d_node, (vec_id * 7 % 11)::DOUBLE AS d_seg FROM embeddings)"""


@query(f"WITH {_CP}, r AS (SELECT *, row_number() OVER (PARTITION BY node_id, link_id, link_end ORDER BY d_seg, d_node, cp_id) AS k FROM cp) SELECT node_id, link_id, link_end, cp_id FROM r WHERE k = 1")
def nearest_cp_per_link_end(spark, sf_dir) -> DataFrame:
    return points.nearest_per_link_end(fixtures.connection_points(spark, sf_dir)).select("node_id", "link_id", "link_end", "cp_id")


@query(f"""WITH {_CP}, c AS (SELECT cp_id % 50 AS cp_id, link_id, d_seg, d_node FROM cp), m AS (SELECT *, min(d_seg) OVER (PARTITION BY cp_id) AS best FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY cp_id ORDER BY d_node, d_seg, link_id) AS k FROM m WHERE d_seg <= best + 0.5) SELECT cp_id, link_id FROM r WHERE k = 1""")
def nearest_link_per_cp(spark, sf_dir) -> DataFrame:
    cp = fixtures.connection_points(spark, sf_dir).withColumn("cp_id", F.col("cp_id") % 50)
    return points.nearest_link_per_point(cp, 0.5).select("cp_id", "link_id")


_INCE = _CP + """, ce AS (SELECT node_id, cp_id, unnest([cp_id % 40, (cp_id * 7) % 300]) AS edge FROM cp), sh AS (SELECT node_id, edge FROM ce GROUP BY 1, 2 HAVING count(DISTINCT cp_id) >= 2)"""


def _cp_edges(spark, sf_dir) -> DataFrame:
    return fixtures.connection_points(spark, sf_dir).withColumn("edges", F.array(F.col("cp_id") % 40, (F.col("cp_id") * 7) % 300))


@query(f"WITH {_INCE} SELECT DISTINCT ce.node_id, cp_id FROM ce JOIN sh ON sh.node_id = ce.node_id AND sh.edge = ce.edge")
def drop_unlinked(spark, sf_dir) -> DataFrame:
    return points.drop_unlinked(_cp_edges(spark, sf_dir)).select("node_id", "cp_id")


@query(f"""WITH {_INCE}, kept AS (SELECT DISTINCT ce.node_id, cp_id FROM ce JOIN sh ON sh.node_id = ce.node_id AND sh.edge = ce.edge),
gone AS (SELECT * FROM cp WHERE (node_id, cp_id) NOT IN (SELECT node_id, cp_id FROM kept)),
cov AS (SELECT DISTINCT cp.node_id, link_id, link_end FROM cp JOIN kept USING (node_id, cp_id)),
fix AS (SELECT g.node_id, g.cp_id, row_number() OVER (PARTITION BY g.node_id, g.link_id, g.link_end ORDER BY d_seg, d_node, g.cp_id) AS k FROM gone g LEFT JOIN cov c ON c.node_id = g.node_id AND c.link_id = g.link_id AND c.link_end = g.link_end WHERE c.node_id IS NULL)
SELECT node_id, cp_id FROM kept UNION SELECT node_id, cp_id FROM fix WHERE k = 1""")
def peer_filter(spark, sf_dir) -> DataFrame:
    return points.peer_filter(_cp_edges(spark, sf_dir)).select("node_id", "cp_id")


_NEAR = _CP + """, seed AS (SELECT node_id, avg(x) AS sx, avg(y) AS sy FROM cp GROUP BY 1), near AS (SELECT s.node_id, c.cp_id, degrees(atan2(c.y - sy, c.x - sx)) AS a FROM seed s JOIN cp c ON sqrt((c.x - sx) * (c.x - sx) + (c.y - sy) * (c.y - sy)) <= 12 WHERE c.x <> sx OR c.y <> sy),
ang AS (SELECT node_id, CASE WHEN a < 0 THEN a + 360 ELSE a END AS a FROM near), gap AS (SELECT node_id, a, coalesce(lead(a) OVER (PARTITION BY node_id ORDER BY a), 360 + min(a) OVER (PARTITION BY node_id)) - a AS g FROM ang),
cov AS (SELECT node_id, count(*) AS n_points, 360 - max(g) AS span, count(DISTINCT floor(a / 45)) AS sectors FROM gap GROUP BY 1)"""


def _seeds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    cp = fixtures.connection_points(spark, sf_dir)
    return cp.groupBy("node_id").agg(F.avg("x").alias("sx"), F.avg("y").alias("sy")), cp.select("cp_id", "x", "y")


@query(f"WITH {_NEAR} SELECT node_id, n_points, round(span, 4) AS span, sectors FROM cov WHERE n_points >= 3 AND (span >= 200 OR sectors >= 3)")
def lane_coverage_filter(spark, sf_dir) -> DataFrame:
    seeds, pts = _seeds(spark, sf_dir)
    return points.lane_coverage(points.angles_near(seeds, pts, 12.0)).select("node_id", "n_points", F.round("span", 4).alias("span"), "sectors")


@query(f"WITH {_NEAR} SELECT node_id, round(span, 4) AS span, sectors FROM cov WHERE n_points >= 2 AND span >= 120 AND sectors >= 2")
def vector_spread_filter(spark, sf_dir) -> DataFrame:
    seeds, pts = _seeds(spark, sf_dir)
    return points.vector_spread(points.angles_near(seeds, pts, 12.0)).select("node_id", F.round("span", 4).alias("span"), "sectors")


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS link_id, l_partkey AS g FROM lineitem), i AS (SELECT o_custkey AS node_id, o_orderkey AS link_id FROM orders)
SELECT node_id, g AS lane_group_id, count(*) AS n_links FROM i JOIN b USING (link_id) GROUP BY 1, 2 HAVING count(*) >= 2""")
def node_lane_groups(spark, sf_dir) -> DataFrame:
    inc = fixtures.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node_id"), F.col("o_orderkey").alias("link_id"))
    bridge = fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("link_id"), F.col("l_partkey").alias("lane_group_id"))
    return attributes.node_groups(inc, bridge)


@query("""SELECT DISTINCT p_partkey AS tile FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_partkey % 5 = 0 ORDER BY 1 LIMIT 25""")
def tile_intersection(spark, sf_dir) -> DataFrame:
    p = fixtures.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tile"))
    return synthetic.common_tiles([p.where(F.col("tile") % k == 0) for k in (2, 3, 5)], 25)


# views, shapes and way ends

_STREETS = "s AS (SELECT o_orderkey AS link_id, o_custkey % 700 AS u, 700 + o_orderkey % 900 AS v FROM orders)"


def _street_nodes(spark, sf_dir) -> DataFrame:
    s = fixtures.streets(spark, sf_dir)
    n = s.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return n.select("node_id", (F.col("node_id") % 30).cast("double").alias("x"), (F.col("node_id") % 17).cast("double").alias("y"))


@query(f"""WITH {_STREETS}, l AS (SELECT * FROM s WHERE (u % 30 BETWEEN 3 AND 12 AND u % 17 BETWEEN 2 AND 9) OR (v % 30 BETWEEN 3 AND 12 AND v % 17 BETWEEN 2 AND 9))
SELECT 'link' AS kind, link_id AS id FROM l UNION SELECT 'node', u FROM l UNION SELECT 'node', v FROM l""")
def view_selection(spark, sf_dir) -> DataFrame:
    nodes = _street_nodes(spark, sf_dir).withColumnsRenamed({"x": "lat", "y": "lon"})
    links, ends = views.view(fixtures.streets(spark, sf_dir), nodes, (12.0, 2.0, 3.0, 9.0))
    return links.select(F.lit("link").alias("kind"), F.col("link_id").alias("id")).union(ends.select(F.lit("node"), "node_id"))


def _box(either: bool):
    def run(spark, sf_dir) -> DataFrame:
        edges = fixtures.streets(spark, sf_dir).select("link_id", F.col("u").alias("src"), F.col("v").alias("dst"))
        return views.edges_in_box(edges, _street_nodes(spark, sf_dir), (3.0, 2.0, 12.0, 9.0), "either" if either else "both").select("link_id")

    return run


for _either, _name, _op in ((False, "edges_within_box", "AND"), (True, "edges_touching_box", "OR")):
    QUERIES[_name] = _box(_either)
    SQL[_name] = f"WITH {_STREETS} SELECT link_id FROM s WHERE (u % 30 BETWEEN 3 AND 12 AND u % 17 BETWEEN 2 AND 9) {_op} (v % 30 BETWEEN 3 AND 12 AND v % 17 BETWEEN 2 AND 9)"


@query("""WITH p AS (SELECT l_orderkey AS line_id, (l_partkey % 100)::DOUBLE AS x, (l_suppkey % 50)::DOUBLE AS y FROM lineitem),
m AS (SELECT *, avg(x) OVER (PARTITION BY line_id) AS mx, avg(y) OVER (PARTITION BY line_id) AS my FROM p),
t AS (SELECT line_id, sum((x - mx) ** 2) AS xx, sum((x - mx) * (y - my)) AS xy, sum((y - my) ** 2) AS yy FROM m GROUP BY 1)
SELECT line_id, round(1 - (yy - CASE WHEN xx > 0 THEN xy * xy / xx ELSE 0 END) / (yy + 1e-9), 5) AS r2 FROM t""")
def polyline_straightness(spark, sf_dir) -> DataFrame:
    l = fixtures.table(spark, sf_dir, "lineitem")
    p = F.struct((F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_suppkey") % 50).cast("double").alias("y"))
    lines = l.groupBy(F.col("l_orderkey").alias("line_id")).agg(F.collect_list(p).alias("points"))
    return lines.select("line_id", F.round(polyline.straightness(F.col("points")), 5).alias("r2"))


@query(f"""WITH {_STREETS} SELECT u % 50 AS lane_id, string_agg(DISTINCT u::VARCHAR, ',' ORDER BY u::VARCHAR) AS starts, string_agg(DISTINCT v::VARCHAR, ',' ORDER BY v::VARCHAR) AS ends FROM s WHERE u % 50 < 20 GROUP BY 1""")
def lane_terminals(spark, sf_dir) -> DataFrame:
    e = fixtures.streets(spark, sf_dir).select((F.col("u") % 50).alias("lane_id"), F.col("u").alias("src"), F.col("v").alias("dst"))
    found = graphs.lane_terminals(e, e.where("lane_id < 20"))
    as_text = lambda c: F.array_join(F.array_sort(F.transform(c, lambda v: v.cast("string"))), ",").alias(c)
    return found.select("lane_id", as_text("starts"), as_text("ends"))


# rows only: order-dependent or set-valued results, or too long for recursive SQL

@query()
def shortest_path_lengths_whole(spark, sf_dir) -> DataFrame:
    """The ways of ``shortest_path_lengths`` without its limit of 40."""
    o = fixtures.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    edges = o.select(k.alias("src"), F.when(k % 7 == 0, k + 3).otherwise(k + 1).alias("dst"), (1 + F.col("o_custkey") % 9).alias("weight"))
    return graphs.shortest_paths(spark, edges, o.where(k % 100 == 0).select(k.alias("node")), max_rounds=1_000_000).select("node", "dist")


_LANE_ENDS = """li AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_linestatus DESC) = 1),
le AS (SELECT l_orderkey * 8 + l_linenumber AS cp_id, l_orderkey AS node_id, l_suppkey % 2 AS link_id, CASE WHEN l_linestatus = 'O' THEN 'start' ELSE 'end' END AS link_end,
  CASE WHEN l_linenumber % 4 > 0 THEN l_linenumber % 2 END AS lane_no, l_partkey % 41 - 20 AS dx, l_quantity::BIGINT % 41 - 20 AS dy, (l_suppkey % 11) / 10.0::DOUBLE AS d_seg, (l_partkey % 10) / 10.0::DOUBLE AS t FROM li),
near AS (SELECT *, sqrt((dx * dx + dy * dy)::DOUBLE) AS d_node, coalesce(lane_no::VARCHAR, 'none ' || cp_id) AS lane FROM le WHERE CASE WHEN link_end = 'start' THEN t ELSE 1 - t END <= 0.2)"""


@query(f"""WITH {_LANE_ENDS}, best AS (SELECT *, min(d_node) FILTER (d_seg <= 0.5) OVER (PARTITION BY node_id, link_id, link_end, lane) AS b FROM near)
SELECT cp_id, node_id FROM best WHERE d_seg > 0.5 OR d_node <= b + 0.05""")
def near_end_thinning(spark, sf_dir) -> DataFrame:
    return points.thin_per_lane(fixtures.lane_ends(spark, sf_dir)).select("cp_id", "node_id")


@query(f"""WITH {_LANE_ENDS} SELECT cp_id, node_id FROM near n WHERE d_seg > 0.5 OR NOT EXISTS (SELECT 1 FROM near m WHERE m.node_id = n.node_id AND m.link_id = n.link_id
  AND m.link_end = n.link_end AND m.lane = n.lane AND m.d_seg <= 0.5 AND m.d_node < n.d_node - 0.05 AND m.dx * n.dx + m.dy * n.dy < 0)""")
def opposite_side_thinning(spark, sf_dir) -> DataFrame:
    return points.thin_per_lane(fixtures.lane_ends(spark, sf_dir), opposite=True).select("cp_id", "node_id")


@query()
def sector_cull(spark, sf_dir) -> DataFrame:
    return points.sector_cull(fixtures.lane_ends(spark, sf_dir), by_lane=False).select("cp_id", "node_id")


@query()
def sector_cull_by_lane(spark, sf_dir) -> DataFrame:
    return points.sector_cull(fixtures.lane_ends(spark, sf_dir), scope="link").select("cp_id", "node_id")


@query()
def farther_connected_prune(spark, sf_dir) -> DataFrame:
    return points.drop_farther_connected(fixtures.lane_ends(spark, sf_dir)).select("cp_id", "node_id")


@query()
def interior_linked_only(spark, sf_dir) -> DataFrame:
    return points.prefer_interior(fixtures.lane_ends(spark, sf_dir), True, by_end=False).select("cp_id", "node_id")


@query()
def interior_over_hull(spark, sf_dir) -> DataFrame:
    return points.prefer_interior(fixtures.lane_ends(spark, sf_dir), False, by_end=False).select("cp_id", "node_id")


@query()
def angular_seed_nodes(spark, sf_dir) -> DataFrame:
    l = fixtures.lane_ends(spark, sf_dir).where("d_node > 0")
    around = l.select("node_id", F.pmod(F.degrees(F.atan2(F.col("y") - F.col("ny"), F.col("x") - F.col("nx"))), F.lit(360.0)).alias("angle"))
    return points.seed_nodes(around).withColumn("leg_angles", F.array_join(F.transform("leg_angles", lambda a: F.round(a, 6).cast("string")), ","))


def _shapes(found: DataFrame) -> DataFrame:
    return found.select("node_id", text_of("cp_ids"), text_of("perimeter"), F.round("area", 6).alias("area"), F.round("min_angle", 6).alias("min_angle"), F.round("max_angle", 6).alias("max_angle"))


@query()
def x4_finder(spark, sf_dir) -> DataFrame:
    return _shapes(points.four_legs(*fixtures.rings(spark, sf_dir, 8)))


@query()
def t3_finder(spark, sf_dir) -> DataFrame:
    return _shapes(points.three_legs(*fixtures.rings(spark, sf_dir, 6)))


@query()
def convex_hull(spark, sf_dir) -> DataFrame:
    cp = fixtures.connection_points(spark, sf_dir)
    return cp.groupBy("node_id").agg(F.collect_list(F.struct("x", "y")).alias("p")).select("node_id", F.to_json(polyline.convex_hull("p")).alias("hull"))


def queries() -> dict:
    from wayloom.plans import shapes  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from wayloom.plans import shapes  # noqa: F401

    return dict(SQL)
