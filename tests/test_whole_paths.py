import heapq

from wayloom.plans import catalogue


def test_path_lengths_are_those_of_dijkstra(spark, tmp_path):
    rows = [(k, k * 31 % 17) for k in range(95, 128)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    edge = {k: (k + 3 if k % 7 == 0 else k + 1, 1 + c % 9) for k, c in rows}
    want, heap = {}, [(0, 100)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in want:
            want[n] = d
            if n in edge:
                heapq.heappush(heap, (d + edge[n][1], edge[n][0]))
    got = catalogue.queries()["shortest_path_lengths_whole"](spark, str(tmp_path)).collect()
    assert {r.node: r.dist for r in got} == want and max(want.values()) > 40
