"""Link classification and the dual graph: links are vertices, shared road nodes are edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.plans.numbering import number_rows, running_sum
from wayloom.plans.scratch import Scratch

OTHER, PRIMARY, SECONDARY = 0, 1, 2


def link_types(links: DataFrame, secondary: DataFrame, primary: DataFrame) -> DataFrame:
    """``links`` with link_type from two tables of link_id; a link in both is secondary."""
    s = secondary.select("link_id", F.lit(True).alias("_s")).distinct()
    p = primary.select("link_id", F.lit(True).alias("_p")).distinct()
    kind = F.when(F.col("_s"), SECONDARY).when(F.col("_p"), PRIMARY).otherwise(OTHER)
    return links.drop("link_type").join(s, "link_id", "left").join(p, "link_id", "left").withColumn("link_type", kind).drop("_s", "_p")


def type_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("link_type").agg(F.count(F.lit(1)).alias("n_links"))


def classified(links: DataFrame) -> DataFrame:
    """Links that enter the graph; unclassified ones don't, even as bridges."""
    return links.where(F.col("link_type") > OTHER)


def link_ends(links: DataFrame) -> DataFrame:
    """link_id, link_type, node: both ends, once each for a loop."""
    ends = F.array_distinct(F.array("u", "v"))
    return links.where("u is not null and v is not null").select("link_id", "link_type", F.explode(ends).alias("node"))


def dual_edges(links: DataFrame, from_types: tuple[int, ...] = (PRIMARY, SECONDARY), to_types: tuple[int, ...] = (PRIMARY, SECONDARY)) -> DataFrame:
    """src, dst: ordered pairs of different classified links that share a road node, each once.

    The types narrow both sides before the join, so callers that need one kind
    of adjacency don't build the others.
    """
    ends = link_ends(classified(links))
    a = ends.where(F.col("link_type").isin(*from_types)).select(F.col("link_id").alias("src"), "node")
    b = ends.where(F.col("link_type").isin(*to_types)).select(F.col("link_id").alias("dst"), "node")
    return a.join(b, "node").where("src <> dst").select("src", "dst").distinct()


def dense_index(links: DataFrame, scratch: Scratch, by_text: bool = True) -> DataFrame:
    """Classified links with idx from 0: in the order of their ids as text, or as numbers."""
    key = F.col("link_id").cast("string") if by_text else F.col("link_id")
    return number_rows(classified(links), [key], "idx", scratch, start=0)


def csr_rows(edges: DataFrame, vertices: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """link_id, degree, row_offset, neighbours (sorted): rows in the order of link_id, isolated ones with degree 0."""
    near = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
    rows = vertices.select("link_id").join(near.withColumnRenamed("src", "link_id"), "link_id", "left")
    rows = rows.withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<bigint>"))).withColumn("degree", F.size("neighbours"))
    return running_sum(rows, [F.col("link_id")], "degree", "row_offset", scratch or Scratch(edges.sparkSession, "csr"))
