"""Numbers of candidates and merged junctions: text order of ids, roots of the merge."""

from pyspark.sql import functions as F

from wayloom.operators import junctions
from wayloom.plans.scratch import Scratch


def links_of(spark, rows, kind):
    return spark.createDataFrame(rows, "link_id long, u long, v long, link_type int").withColumn("link_id", F.col("link_id").cast(kind))


def test_seed_is_first_as_text_whatever_the_type(spark):
    rows = [(100, 0, 1, 1), (9, 1, 2, 2), (10, 2, 3, 2), (101, 3, 4, 1)]
    for kind, seed in (("long", 10), ("string", "10")):
        links = links_of(spark, rows, kind)
        points = links.select("link_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        got = junctions.detect(spark, links, points).junctions.collect()
        assert [(r.junction_id, r.seed_link_id) for r in got] == [(1, seed)]


def test_root_differs_from_the_least_member(spark):
    """Candidates 1 to 4 with merges (1, 4) and (3, 4): the root of the three is 3, so 2 is numbered before them."""
    numbered = spark.createDataFrame([(f"c{k}", k) for k in range(1, 5)], "component string, number long")
    edges = spark.createDataFrame([("c1", "c4"), ("c3", "c4")], "a string, b string")
    got = {r.component: (r.group, r.root) for r in junctions.merge_groups(spark, numbered, edges, Scratch(spark, "t")).collect()}
    assert got == {"c1": (1, 3), "c3": (1, 3), "c4": (1, 3), "c2": (2, 2)}


def test_sources_of_numbers_meet_the_reference_order(spark):
    """Four candidates along a line, merged 1-4 and 3-4 by distance: ids follow the roots, seeds the first members."""
    rows, points = [], []
    place = {11: (0.0, 0.0), 21: (5000.0, 0.0), 31: (400.0, 0.0), 41: (200.0, 0.0)}  # candidates by text: 11, 21, 31, 41
    for k, (x, y) in place.items():
        n = k * 10
        rows += [(1000 + k, n, n + 1, 1), (k, n + 1, n + 2, 2), (k + 1, n + 2, n + 3, 2), (2000 + k, n + 3, n + 4, 1)]
        points += [(k, x, y), (k + 1, x, y)]
    d = junctions.detect(spark, links_of(spark, rows, "long"), spark.createDataFrame(points, "link_id long, x double, y double"))
    got = [(r.junction_id, r.seed_link_id, len(r.secondary_ids)) for r in d.junctions.orderBy("junction_id").collect()]
    assert got == [(1, 21, 2), (2, 11, 6)]


def test_a_node_of_many_links_stays_linear(spark):
    rows = [(k, 0, k, 2) for k in range(1, 3001)]
    scratch = Scratch(spark, "hub")
    got = junctions.secondary_components(spark, links_of(spark, rows, "long"), scratch)
    assert got.count() == 3000 and [r.component for r in got.select("component").distinct().collect()] == [1]
