"""Complex junctions: groups of secondary links, their primary boundary, and the merging of near groups."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.operators.components import connected_components
from wayloom.operators.dual import PRIMARY, SECONDARY, dual_edges, link_ends
from wayloom.operators.spatial import range_join
from wayloom.plans.numbering import number_rows
from wayloom.plans.scratch import Scratch


@dataclass(frozen=True)
class Limits:
    """Least sizes of a candidate and the distances of a merge, in metres, both inclusive."""

    min_secondary: int = 2
    min_primary: int = 2
    min_shared: int = 1
    local_distance: float | None = 50.0
    centroid_distance: float = 300.0
    primary_hops: int = 0


def secondary_components(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """link_id, component (its first secondary link in the order of ids as text): every secondary link, alone or not.

    The links at a road node are joined to the least of them, so a node of d links has d edges, not d * d.
    """
    kind = links.schema["link_id"].dataType
    own = links.where(F.col("link_type") == SECONDARY)
    ends = link_ends(own).select("node", "link_id")
    least = ends.groupBy("node").agg(F.min("link_id").alias("dst")).select(F.xxhash64("node").alias("k"), F.col("node").alias("n2"), "dst")
    star = ends.withColumn("k", F.xxhash64("node")).join(least, "k").where("node = n2").select(F.col("link_id").alias("src"), "dst")
    edges = star.union(own.select(F.col("link_id").alias("src"), F.col("link_id").alias("dst")))
    found = scratch.cut(connected_components(spark, edges, "src", "dst", scratch), "labels")
    first = found.groupBy("component").agg(F.min(F.col("id").cast("string")).alias("first"))
    first = first.select(F.xxhash64("component").alias("k"), F.col("component").alias("c2"), "first")
    named = found.withColumn("k", F.xxhash64("component")).join(first, "k").where("component = c2")
    return named.select(F.col("id").alias("link_id"), F.col("first").cast(kind).alias("component"))


def component_boundary(links: DataFrame, components: DataFrame) -> DataFrame:
    """component, primary_id: primaries next to a secondary link of the component."""
    edges = dual_edges(links, (SECONDARY,), (PRIMARY,))
    return edges.join(components, edges.src == components.link_id).select("component", F.col("dst").alias("primary_id")).distinct()


def candidates(components: DataFrame, boundary: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """component, n_secondary, n_primary of those that are large enough."""
    n_sec = components.groupBy("component").agg(F.count(F.lit(1)).alias("n_secondary")).where(F.col("n_secondary") >= limits.min_secondary)
    n_pri = boundary.groupBy("component").agg(F.count(F.lit(1)).alias("n_primary")).where(F.col("n_primary") >= limits.min_primary)
    return n_sec.join(n_pri, "component")


def shared_primary_pairs(accepted: DataFrame, boundary: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """a, b, n_shared (a < b): candidates with enough primaries in common."""
    own = boundary.join(accepted.select("component"), "component", "left_semi")
    x = own.select(F.col("component").alias("a"), "primary_id")
    y = own.select(F.col("component").alias("b"), "primary_id")
    return x.join(y, "primary_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared")).where(F.col("n_shared") >= limits.min_shared)


def primaries_within_hops(boundary: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """component, primary_id: the boundary and primaries reached from it through primaries in at most ``hops`` steps."""
    edges = dual_edges(links, (PRIMARY,), (PRIMARY,))
    out = boundary.select("component", "primary_id").distinct()
    for _ in range(hops):
        step = out.join(edges, out.primary_id == edges.src).select("component", F.col("dst").alias("primary_id"))
        out = out.union(step).distinct()
    return out


def related_pairs(accepted: DataFrame, boundary: DataFrame, links: DataFrame, limits: Limits) -> DataFrame:
    """a, b: pairs that share primaries, or have some within the hops of each other."""
    pairs = shared_primary_pairs(accepted, boundary, limits).select("a", "b")
    if limits.primary_hops:
        own = boundary.join(accepted.select("component"), "component", "left_semi")
        far = primaries_within_hops(own, links, limits.primary_hops).select(F.col("component").alias("c"), F.col("primary_id").alias("p"))
        both = far.join(own, far.p == own.primary_id).where("c <> component")
        pairs = pairs.union(both.select(F.least("c", "component").alias("a"), F.greatest("c", "component").alias("b"))).distinct()
    return pairs


def member_points(components: DataFrame, accepted: DataFrame, points: DataFrame) -> DataFrame:
    """component, x, y: the finite points of the secondary links of candidates."""
    own = components.join(accepted.select("component"), "component", "left_semi")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    return own.join(points, "link_id").where(finite("x") & finite("y")).select("component", "link_id", "x", "y")


def min_distances(pairs: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """a, b, min_dist of the pairs whose points come within ``radius``."""
    left = pairs.join(points.select(F.col("component").alias("a"), F.col("x"), F.col("y")), "a")
    right = points.select(F.col("component").alias("b2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = range_join(left, right, radius, extra=[("b", "b2")])
    return near.groupBy("a", "b").agg(F.min("dist").alias("min_dist"))


def centroids(points: DataFrame) -> DataFrame:
    """component, cx, cy: means over all points; a candidate without points has none and merges by no distance."""
    return points.groupBy("component").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def centroid_pairs(centres: DataFrame, radius: float) -> DataFrame:
    """a, b, dist (a < b) of all candidates whose centroids are within ``radius``."""
    left = centres.select(F.col("component").alias("a"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    right = centres.select(F.col("component").alias("b"), F.col("cx").alias("x2"), F.col("cy").alias("y2"))
    return range_join(left, right, radius).where("a < b").select("a", "b", "dist")


def merge_edges(related: DataFrame, points: DataFrame, centres: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """a, b: related and within the local distance, or centroids near."""
    if limits.local_distance is None:
        local = related.select("a", "b")
    else:
        local = min_distances(related, points, limits.local_distance).select("a", "b")
    return local.union(centroid_pairs(centres, limits.centroid_distance).select("a", "b")).distinct()


def _roots(pdf: pd.DataFrame) -> pd.DataFrame:
    """The root that each group's pairs leave, joined in order: the second's root goes under the first's."""
    parent = {int(n): int(n) for n in pd.unique(pdf[["i", "k"]].to_numpy().ravel())}

    def root(n: int) -> int:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for i, k in sorted(zip(pdf.i.tolist(), pdf.k.tolist(), strict=True)):
        a, b = root(i), root(k)
        if a != b:
            parent[b] = a
    return pd.DataFrame({"group": pdf.group.iloc[0], "root": [root(int(pdf.i.iloc[0]))]})


def merge_groups(spark: SparkSession, numbered: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """component, number, group, root of every candidate, from (component, number) and merge edges (a, b)."""
    num = numbered.select("component", "number")
    e = (edges.join(num.select(F.col("component").alias("a"), F.col("number").alias("i")), "a")
         .join(num.select(F.col("component").alias("b"), F.col("number").alias("j")), "b")
         .select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("k")))
    e = scratch.cut(e, "merge-edges")
    groups = connected_components(spark, e, "i", "k", scratch).select(F.col("id").alias("number"), F.col("component").alias("group"))
    groups = scratch.cut(groups, "merge-groups")
    per = e.join(groups.withColumnRenamed("number", "i"), "i").select("group", "i", "k")
    roots = per.groupBy("group").applyInPandas(_roots, "group long, root long")
    placed = num.join(groups, "number", "left").withColumn("group", F.coalesce("group", "number")).join(roots, "group", "left")
    return placed.select("component", "number", "group", F.coalesce("root", "number").alias("root"))


@dataclass
class Detection:
    """The tables of one detection, each as needed."""

    components: DataFrame
    boundary: DataFrame
    accepted: DataFrame
    points: DataFrame
    edges: DataFrame
    groups: DataFrame
    junctions: DataFrame


def detect(spark: SparkSession, links: DataFrame, points: DataFrame, limits: Limits = Limits(), scratch: Scratch | None = None) -> Detection:
    """From links (link_id, u, v, link_type) and points (link_id, x, y) to merged junctions.

    junctions: junction_id, seed_link_id, secondary_ids, primary_ids. Candidates are numbered in the
    order of their first links' ids as text; merged numbers go by ascending root of the merge, the
    seed is that of the first candidate.
    """
    scratch = scratch or Scratch(spark, "junctions")
    links = scratch.cut(links, "links")
    comp = scratch.cut(secondary_components(spark, links, scratch), "components")
    bound = scratch.cut(component_boundary(links, comp), "boundary")
    acc = scratch.cut(candidates(comp, bound, limits), "accepted")
    pts = scratch.cut(member_points(comp, acc, points), "points")
    edges = merge_edges(related_pairs(acc, bound, links, limits), pts, centroids(pts), limits)
    numbered = number_rows(acc, [F.col("component").cast("string")], "number", scratch)
    groups = scratch.cut(merge_groups(spark, numbered, edges, scratch), "groups")
    sec = comp.join(groups.select("component", "root"), "component").groupBy("root").agg(F.array_sort(F.collect_set("link_id")).alias("secondary_ids"))
    pri = bound.join(groups.select("component", "root"), "component").groupBy("root").agg(F.array_sort(F.collect_set("primary_id")).alias("primary_ids"))
    seed = groups.groupBy("root").agg(F.min_by("component", "number").alias("seed_link_id"))
    merged = number_rows(seed.join(sec, "root").join(pri, "root"), [F.col("root")], "junction_id", scratch)
    return Detection(comp, bound, acc, pts, edges, groups, merged.select("junction_id", "seed_link_id", "secondary_ids", "primary_ids"))


def link_roles(junctions: DataFrame) -> DataFrame:
    """junction_id, link_id, role, u, v: every link once; ramp before main; end nodes are 2 link and 2 link + 1."""
    ids = F.explode(F.array_sort(F.array_union("secondary_ids", "primary_ids"))).alias("link_id")
    rows = junctions.select("junction_id", "secondary_ids", "primary_ids", ids)
    role = (F.when(F.array_contains("secondary_ids", F.col("link_id")), "ramp").when(F.array_contains("primary_ids", F.col("link_id")), "main").otherwise("undefined"))
    return rows.select("junction_id", "link_id", role.alias("role"), (F.col("link_id") * 2).alias("u"), (F.col("link_id") * 2 + 1).alias("v"))


def report_row(links: DataFrame, directed_edges: DataFrame, junctions: DataFrame) -> DataFrame:
    """One row: roads, secondary, primary, directed_edges, junctions."""
    kinds = links.agg(F.count_if(F.col("link_type") > 0).alias("roads"), F.count_if(F.col("link_type") == SECONDARY).alias("secondary"), F.count_if(F.col("link_type") == PRIMARY).alias("primary_links"))
    edges = directed_edges.agg(F.count(F.lit(1)).alias("directed_edges"))
    found = junctions.agg(F.count(F.lit(1)).alias("junctions"))
    one = F.lit(1).alias("_one")  # three one-row tables
    return kinds.select("*", one).join(edges.select("*", one), "_one").join(found.select("*", one), "_one").drop("_one")
