"""Connected components by alternating large-star and small-star steps.

Every step is a join and two aggregates over the edge table, so no component
and no adjacency list is ever gathered in one place; the number of steps grows
with the logarithm of the longest path. Each step is written to the shared
scratch folder, which cuts the lineage and survives a lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.plans.scratch import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and its partners.

    The join key is a hash of u: the aggregate's own partitioning is not reused,
    so a vertex with very many partners can be split at run time.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("w"))
    least = least.select(F.xxhash64("u").alias("k"), F.col("u").alias("u2"), F.least("u", "w").alias("m"))
    return (edges.withColumn("k", F.xxhash64("u")).join(least, "k").where(F.col("u") == F.col("u2")).select("u", "v", "m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex is either a centre or has exactly one edge, to its centre."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select("u", one.alias("out"), none.alias("in")).union(edges.select("v", none, one))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out = 1 and in = 1)").isEmpty()


def connected_components(spark: SparkSession, edges: DataFrame, src: str = "src", dst: str = "dst",
                         scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that occurs in ``edges``.

    Self edges give a vertex its own component; null ends are ignored; an empty
    table gives an empty result. Raises if ``max_rounds`` do not suffice.
    """
    scratch = scratch or Scratch(spark, "components")
    named = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = named.where("u = v").select("u", "v")
    now = named.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    last = None
    for k in range(max_rounds):
        large = (_with_least(_both(now)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        star = _with_least(large)
        small = (star.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(star.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        name = f"stars{scratch.n}"
        now = scratch.cut(small, name)
        if last:
            scratch.drop(last)
        last = name
        if _are_stars(now):
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).union(
        loops.select(F.col("u").alias("id"), F.col("v").alias("component"))
    ).groupBy("id").agg(F.min("component").alias("component"))
