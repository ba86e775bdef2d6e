import math
import random
import time

import pytest

from wayloom.operators.spatial import k_nearest


def brute(queries, points, k):
    out = {}
    for q, x, y in queries:
        near = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), p) for p, a, b in points)
        out[q] = [(p, pytest.approx(d, rel=1e-9, abs=1e-6)) for d, p in near[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.q_id, r["rank"])):
        out.setdefault(r.q_id, []).append((r.p_id, r.dist))
    return out


@pytest.mark.parametrize("k,cell,crowd", [(1, 10.0, 64), (5, 3.0, 2), (40, 1000.0, 8)])
def test_nearest_points_by_brute_force(spark, k, cell, crowd):
    r = random.Random(k)
    points = [(i, r.gauss(0, 5), r.gauss(0, 5)) for i in range(200)] + [(200 + i, r.uniform(-900, 900), r.uniform(-900, 900)) for i in range(100)]
    queries = [(i, r.uniform(-1000, 1000), r.uniform(-1000, 1000)) for i in range(60)] + [(99, 1e5, -3e5), (100, 0.0, 0.0)]
    q = spark.createDataFrame([*queries, (500, float("nan"), 0.0), (501, None, 1.0)], "q_id int, qx double, qy double")
    p = spark.createDataFrame([*points, (999, float("inf"), 0.0), (998, None, None)], "p_id int, x double, y double")
    assert found(k_nearest(q, p, k, cell, crowd=crowd)) == brute(queries, points, k)


def test_a_point_far_away_is_found_at_once(spark):
    t = time.time()
    q = spark.createDataFrame([(1, 0.0, 0.0)], "q_id int, qx double, qy double")
    p = spark.createDataFrame([(7, 1e5, 0.0), (8, 1e5, 1.0), (9, 2e5, 0.0)], "p_id int, x double, y double")
    df = k_nearest(q, p, 2, 1.0)
    assert [(r.p_id, r["rank"]) for r in df.orderBy("rank").collect()] == [(7, 1), (8, 2)]
    assert len(df._jdf.queryExecution().toString()) < 50_000 and time.time() - t < 60


def test_ties_repeated_and_few_points(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "q_id int, qx double, qy double")
    p = spark.createDataFrame([(k, 1.0, 1.0) for k in range(100)], "p_id int, x double, y double")
    assert found(k_nearest(q, p, 3, 0.5, crowd=2)) == {i: [(k, pytest.approx(math.sqrt(2))) for k in range(3)] for i in (1, 2)}
    assert k_nearest(q, p.limit(2), 5, 0.5).count() == 4 and k_nearest(q, p.limit(0), 5, 0.5).count() == 0 and k_nearest(q.limit(0), p, 1, 1.0).count() == 0
