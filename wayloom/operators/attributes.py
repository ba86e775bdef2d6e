"""Routing and lane attributes: ranges, intervals, directions, summaries, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS_JOIN, EPS_EMPTY = 1e-9, 1e-12


def range_of(start: Column, end: Column, from_start: Column, from_end: Column) -> Column:
    """struct(s0, s1): start and end, else the offset from the start on, else up to the offset from the end; within [0, 1], whole if empty."""
    num = lambda c: c.cast("string").try_cast("double")
    a, b, fs, fe = (num(c) for c in (start, end, from_start, from_end))
    lo = F.when(a.isNotNull() & b.isNotNull(), a).when(fs.isNotNull(), fs).otherwise(F.lit(0.0))
    hi = F.when(a.isNotNull() & b.isNotNull(), b).when(fs.isNotNull() & fe.isNotNull(), 1 - fe).when(fs.isNotNull(), F.lit(1.0)).when(fe.isNotNull(), 1 - fe).otherwise(F.lit(1.0))
    lo, hi = (F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) for c in (lo, hi))
    bad = ~(hi > lo)
    return F.struct(F.when(bad, 0.0).otherwise(lo).alias("s0"), F.when(bad, 1.0).otherwise(hi).alias("s1"))


def coalesce_intervals(rows: DataFrame, keys: list[str], lo: str = "s0", hi: str = "s1") -> DataFrame:
    """keys, s0, s1: intervals of [0, 1] joined where they overlap or nearly touch; empty ones dropped."""
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    cut = rows.select(*keys, clip(lo).alias("s0"), clip(hi).alias("s1")).where(F.col("s1") - F.col("s0") > EPS_EMPTY)
    order = Window.partitionBy(*keys).orderBy("s0", "s1")
    reach = F.max("s1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("s0") > reach + EPS_JOIN), 1).otherwise(0)
    marked = cut.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1")).drop("_island")


def direction_summary(rows: DataFrame, keys: list[str], direction: str = "direction") -> DataFrame:
    """keys, allowed: BOTH, FWD, BWD or NONE over the directions of a key's rows."""
    has = lambda *d: F.coalesce(F.bool_or(F.upper(direction).isin(*d)), F.lit(False))
    return rows.groupBy(*keys).agg(has("FORWARD", "FWD").alias("_f"), has("BACKWARD", "BWD").alias("_b"), has("BOTH").alias("_o")).select(
        *keys, F.when(F.col("_o") | (F.col("_f") & F.col("_b")), "BOTH").when(F.col("_f"), "FWD").when(F.col("_b"), "BWD").otherwise("NONE").alias("allowed"))


def group_directions(groups: DataFrame, rows: DataFrame, key: str = "group_id") -> DataFrame:
    """As ``direction_summary`` for all groups: UNKNOWN without any attribute row, NONE with rows of no direction."""
    return groups.select(key).distinct().join(direction_summary(rows, [key]), key, "left").withColumn("allowed", F.coalesce("allowed", F.lit("UNKNOWN")))


def lane_attributes(rows: DataFrame) -> DataFrame:
    """group_id, lane_no, directions, types, width_profiles, in_intersection, n_ranges from one row per parametric item."""
    return rows.groupBy("group_id", "lane_no").agg(
        F.array_sort(F.collect_set("direction")).alias("directions"), F.array_sort(F.collect_set("lane_type")).alias("types"),
        F.array_sort(F.collect_set("width_profile")).alias("width_profiles"), F.coalesce(F.bool_or("in_intersection"), F.lit(False)).alias("in_intersection"),
        F.count(F.lit(1)).alias("n_ranges"))


def routing_summary(items: DataFrame) -> DataFrame:
    """One row per link: the first functional class, access and area among items ranked by 2 for both directions and 1 for no range, and the flags of any item.

    Items: link_id, item_no, direction, has_range, functional_class, accessible_by, admin_area, is_ramp, is_urban; those missing are null.
    """
    names = set(items.columns)
    col = lambda c, kind: F.col(c) if c in names else F.lit(None).cast(kind)
    rank = F.struct((2 * (F.upper(col("direction", "string")) == "BOTH").cast("int") + (~F.coalesce(col("has_range", "boolean"), F.lit(False))).cast("int")).alias("r"), (-F.col("item_no")).alias("n"))
    first = lambda c: F.max_by(col(c, "string"), F.when(col(c, "string").isNotNull(), rank)).alias(c)
    flag = lambda c: F.coalesce(F.bool_or(col(c, "boolean")), F.lit(False)).alias(c)
    return items.groupBy("link_id").agg(first("functional_class"), first("accessible_by"), first("admin_area"), flag("is_ramp"), flag("is_urban"), flag("is_within_interchange"))


def attach_routing(links: DataFrame, summary: DataFrame) -> DataFrame:
    """Left join; summary columns get the suffix ``_routing``."""
    s = summary.select("link_id", *[F.col(c).alias(f"{c}_routing") for c in summary.columns if c != "link_id"])
    return links.join(s, "link_id", "left")


def dedup_records(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """First row of each structurally equal record."""
    body = [c for c in rows.columns if c != order]
    return rows.withColumn("_k", F.xxhash64(F.to_json(F.struct(*body)))).groupBy(*by, "_k").agg(F.min_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def merge_first_wins(rows: DataFrame, key: str, order: str, lists: list[str]) -> DataFrame:
    """One row a key: the first non-null value of each column in tile order, lists united."""
    others = [c for c in rows.columns if c not in (key, order, *lists)]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others]
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    return rows.groupBy(key).agg(*first, *union)


def bridge_maps(bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """link_id -> lane groups and lane_group_id -> links, distinct and sorted."""
    return (bridge.groupBy("link_id").agg(F.array_sort(F.collect_set("lane_group_id")).alias("lane_groups")),
            bridge.groupBy("lane_group_id").agg(F.array_sort(F.collect_set("link_id")).alias("links")))


def node_groups(incidence: DataFrame, bridge: DataFrame, least: int = 2) -> DataFrame:
    """node_id, lane_group_id: groups that at least two links at the node share."""
    return (incidence.select("node_id", "link_id").distinct().join(bridge.select("link_id", "lane_group_id").distinct(), "link_id")
            .groupBy("node_id", "lane_group_id").agg(F.count(F.lit(1)).alias("n_links")).where(F.col("n_links") >= least))
