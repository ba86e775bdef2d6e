"""From map tiles to junctions: the whole road plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions.predicate import select_links
from wayloom.operators import dual, junctions
from wayloom.plans.scratch import Scratch
from wayloom.sources import tiles

RAMP = "is_ramp == true"
RAMP_OR_INTERCHANGE = "is_ramp == true or is_within_interchange == true"
MAIN = 'functional_class == "FC_1" or functional_class == "FC_2" or functional_class == "FC_3"'


def classify(values: DataFrame, ramp_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(secondary, primary) link ids; a link that is both is secondary."""
    secondary = select_links(values, RAMP if ramp_only else RAMP_OR_INTERCHANGE)
    return secondary, select_links(values, MAIN).join(secondary, "link_id", "left_anti")


def graph_from_tiles(spark: SparkSession, config: dict, ramp_only: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """link_id, u, v, link_type, points (metres around the first tile's origin) of a configuration's links.

    Links come from raw road tiles, else from those with decoded geometry.
    """
    scratch = scratch or Scratch(spark, "roads")
    files = tiles.tile_files(config)
    road = tiles.read_tiles(spark, files["ref"])
    links = tiles.road_links(road)
    if files["topoGeom"]:
        more = tiles.decoded_links(tiles.read_tiles(spark, files["topoGeom"]))
        links = links.unionByName(more.join(links.select("link_id"), "link_id", "left_anti"))
    links = scratch.cut(links, "links")
    origin = tiles.origins(road).orderBy("tile_no").first()
    if origin is None:
        first = links.where("size(lat) > 0").orderBy("link_id").first()
        if first is None:
            raise ValueError("no road link rows")
        lat0, lon0, h0 = first.lat[0], first.lon[0], 0.0
    else:
        lat0, lon0, h0 = origin.origin_lat, origin.origin_lon, origin.origin_alt_m
    values = scratch.cut(tiles.attribute_values(tiles.routing_items(tiles.read_tiles(spark, files["route"]))), "values")
    secondary, primary = classify(values, ramp_only)
    return scratch.cut(dual.link_types(tiles.link_rows(links, lat0, lon0, h0), secondary, primary), "graph")


def graph_rows(links: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of a graph document from links with points: idx, link_id, link_type, neighbours (as indices, ascending), points."""
    index = scratch.cut(dual.dense_index(links, scratch).select("link_id", "link_type", "points", F.col("idx").cast("int").alias("idx")), "indexed")
    edges = dual.dual_edges(links)
    to = index.select(F.col("link_id").alias("dst"), F.col("idx").alias("to"))
    near = edges.join(to, "dst").groupBy(F.col("src").alias("link_id")).agg(F.array_sort(F.collect_list("to")).alias("neighbours"))
    return index.join(near, "link_id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<int>")))


def junctions_from_tiles(spark: SparkSession, config: dict, ramp_only: bool = True, limits: junctions.Limits = junctions.Limits()) -> junctions.Detection:
    g = graph_from_tiles(spark, config, ramp_only)
    points = g.select("link_id", F.posexplode("points").alias("pos", "p")).select("link_id", "pos", "p.x", "p.y")
    return junctions.detect(spark, g.drop("points"), points, limits)
