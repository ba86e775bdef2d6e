"""Readers of map-tile documents.

A tile is one JSON object a file, read whole into a VARIANT, so both encodings
(codes as decimal texts, or numbers decoded before) and both shapes of attribute
payloads (lists of single-key objects, or one object) go through one plan. The
order of tiles is their order in the configuration.
"""

from __future__ import annotations

import json
from functools import reduce
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import geodesy

KINDS = ("geom", "topo", "attr", "ref", "route")


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def is_synthetic(config: dict | None) -> bool:
    return bool((config or {}).get("Synthetic", False)) if isinstance(config, dict) else False


def tile_files(config: dict) -> dict[str, list[str]]:
    """Paths by kind: the explicit lists if all five are there, else prefix and tile."""
    lists = {k: config.get(f"{k}Files") for k in KINDS}
    if all(isinstance(v, list) for v in lists.values()):
        return {**lists, "topoGeom": config.get("topoGeomFiles") or []}
    tiles = config.get("tiles")
    if not tiles:
        raise ValueError("the configuration has neither the five file lists nor tiles")
    full = lambda k: [f"{config[f'{k}Prefix']}{t}.json" for t in tiles] if config.get(f"{k}Prefix") else []
    return {k: full(k) for k in (*KINDS, "topoGeom")}


def read_tiles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """tile_no, tile_id, v: one row a file; a file that isn't JSON has none."""
    if not paths:
        return spark.createDataFrame([], "tile_no int, tile_id string, body string").select("tile_no", "tile_id", F.try_parse_json("body").alias("v"))
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    full = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    named = [(p.getFileSystem(conf).makeQualified(p).toString(), k) for k, p in enumerate(full)]
    order = spark.createDataFrame([(str(PurePosixPath(p.split(":", 1)[-1])), k) for p, k in named], "path string, tile_no int")
    body = spark.read.text(paths, wholetext=True).select(F.regexp_replace(F.regexp_replace("_metadata.file_path", "^[a-z0-9+.-]+:(//[^/]*)?", ""), "^/+", "/").alias("path"), F.try_parse_json("value").alias("v"))
    return body.where("v is not null").join(F.broadcast(order), "path").select("tile_no", get("v", "$.here_tile_id").alias("tile_id"), "v")  # a row a file of the configuration


def get(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _each(df: DataFrame, path: str, name: str) -> DataFrame:
    """A row for each element of an array, with ``name`` and its position from 1."""
    return df.select("*", F.posexplode(get("v", path, "array<variant>")).alias("_p", name)).withColumn("no", F.col("_p") + 1).drop("_p")


def _id(v: Column) -> Column:
    return geodesy.normal_id_text(v)


def _decoded(v: str, diffs: str, alts: str) -> tuple[Column, Column, Column]:
    """(lat, lon, alt_cm) arrays of a stream of codes, or of one decoded before."""
    codes = F.transform(get(v, diffs, "array<string>"), geodesy.parse_uint64)
    absolute = geodesy.xor_stream(F.col("centre"), codes)
    raw = F.col("centre").isNotNull()
    lat = F.when(raw, F.transform(absolute, geodesy.morton_lat)).otherwise(get(v, "$.lat", "array<double>"))
    lon = F.when(raw, F.transform(absolute, geodesy.morton_lon)).otherwise(get(v, "$.lon", "array<double>"))
    alt = F.when(raw, geodesy.altitudes(F.coalesce("origin_alt_cm", F.lit(0).cast("bigint")), get(v, alts, "array<bigint>"))).otherwise(get(v, "$.alt_cm", "array<bigint>"))
    return lat, lon, alt


def _with_centre(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("centre", geodesy.parse_uint64(get("v", "$.tile_center_here_2d_coordinate"))).withColumn("origin_alt_cm", F.coalesce(get("v", "$.tile_center_here_3d_coordinate.cm_from_wgs84_ellipsoid", "bigint"), get("v", "$.origin_alt_cm", "bigint")))


def origins(tiles: DataFrame) -> DataFrame:
    """tile_no, tile_id, origin_lat, origin_lon, origin_alt_m of every tile that says one."""
    t = _with_centre(tiles)
    lat = F.coalesce(geodesy.morton_lat(F.col("centre")), get("v", "$.origin_lat", "double"))
    lon = F.coalesce(geodesy.morton_lon(F.col("centre")), get("v", "$.origin_lon", "double"))
    return t.select("tile_no", "tile_id", lat.alias("origin_lat"), lon.alias("origin_lon"), (F.coalesce("origin_alt_cm", F.lit(0)) / 100).alias("origin_alt_m")).where("origin_lat is not null")


def road_links(tiles: DataFrame) -> DataFrame:
    """link_id, tile_id, start_node_id, end_node_id, lat, lon, length_m: the first tile's record of a link."""
    t = _each(_with_centre(tiles).where("centre is not null"), "$.links_starting_in_tile", "l")
    lat, lon, _ = _decoded("l", "$.geometry.here_2d_coordinate_diffs", "$.geometry.cm_from_wgs84_ellipsoid_diffs")
    t = t.where(get("l", "$.geometry", "variant").isNotNull()).select(
        "tile_no", "tile_id", "no", F.coalesce(_id(get("l", "$.link_id")), F.concat(F.lit("UNKNOWN_LINK_"), F.col("no"))).alias("link_id"),
        _id(get("l", "$.start_node_id")).alias("start_node_id"), _id(get("l", "$.end_node_ref.node_id")).alias("end_node_id"), lat.alias("lat"), lon.alias("lon"), get("l", "$.link_length_meters", "double").alias("length_m"))
    return _first(t, "link_id")


def decoded_links(tiles: DataFrame) -> DataFrame:
    """The same from tiles whose links carry lat and lon."""
    t = _each(tiles, "$.links", "l")
    t = t.select("tile_no", "tile_id", "no", _id(get("l", "$.link_id")).alias("link_id"), _id(get("l", "$.start_node_id")).alias("start_node_id"), _id(get("l", "$.end_node_id")).alias("end_node_id"),
                 get("l", "$.lat", "array<double>").alias("lat"), get("l", "$.lon", "array<double>").alias("lon"), get("l", "$.length_m", "double").alias("length_m"))
    return _first(t.where("link_id is not null"), "link_id")


def _first(rows: DataFrame, key: str) -> DataFrame:
    best = F.min_by(F.struct(*[c for c in rows.columns if c not in ("tile_no", "no", key)]), F.struct("tile_no", "no")).alias("_b")
    return rows.groupBy(key).agg(best).select(key, "_b.*")


def road_nodes(tiles: DataFrame, links: DataFrame) -> DataFrame:
    """node_id, tile_id, lat, lon, morton, out_links, in_links: the first known place of a node, else the end of one of its links."""
    t = _each(_with_centre(tiles).where("centre is not null"), "$.nodes_in_tile", "n")
    code = F.col("centre").bitwiseXOR(geodesy.parse_uint64(get("n", "$.geometry.here_2d_coordinate")))
    t = t.select("tile_no", "tile_id", "no", F.coalesce(_id(get("n", "$.node_id")), F.concat(F.lit("UNKNOWN_NODE_"), F.col("no"))).alias("node_id"), code.alias("morton"))
    order = F.struct("tile_no", "no")
    known = t.groupBy("node_id").agg(F.min_by("tile_id", order).alias("tile_id"), F.min_by("morton", F.when(F.col("morton").isNotNull(), order)).alias("morton"))
    ends = F.array(F.struct(F.col("start_node_id").alias("node_id"), F.lit(True).alias("out"), F.get("lat", F.lit(0)).alias("la"), F.get("lon", F.lit(0)).alias("lo")),
                   F.struct(F.col("end_node_id").alias("node_id"), F.lit(False).alias("out"), F.try_element_at("lat", F.lit(-1)).alias("la"), F.try_element_at("lon", F.lit(-1)).alias("lo")))
    e = links.select("link_id", F.explode(ends).alias("e")).select("link_id", "e.*").where("node_id is not null")
    near = F.min_by(F.struct("la", "lo"), F.when(F.col("la").isNotNull(), F.struct("link_id", "out")))
    e = e.groupBy("node_id").agg(near.alias("p"), F.array_sort(F.collect_set(F.when(F.col("out"), F.col("link_id")))).alias("out_links"), F.array_sort(F.collect_set(F.when(~F.col("out"), F.col("link_id")))).alias("in_links"))
    j = known.join(e, "node_id", "full_outer")
    none = F.array().cast("array<string>")
    return j.select("node_id", F.coalesce("tile_id", F.lit("")).alias("tile_id"), F.coalesce(geodesy.morton_lat(F.col("morton")), F.col("p.la")).alias("lat"), F.coalesce(geodesy.morton_lon(F.col("morton")), F.col("p.lo")).alias("lon"),
                    "morton", F.coalesce("out_links", none).alias("out_links"), F.coalesce("in_links", none).alias("in_links"))


def lane_group_links(tiles: DataFrame) -> DataFrame:
    """link_id, lane_group_id: a row for each reference, from either encoding."""
    t = _each(tiles, "$.link_lane_group_references", "r").select(_id(get("r", "$.link_local_ref")).alias("link_id"), F.explode(get("r", "$.lane_group_references", "array<variant>")).alias("g"))
    return t.select("link_id", _id(F.coalesce(get("g", "$.lane_group_ref.lane_group_id"), get("g", "$.lane_group_id"))).alias("lane_group_id"))


def _payload(item: str, path: str) -> Column:
    """Array of (key, value as JSON) of an attribute payload in either shape; elements that aren't single-key objects go under _raw."""
    raw = get(item, path, "variant")
    listed = F.transform(F.from_json(F.to_json(raw), "array<string>"), lambda x: F.from_json(x, "map<string,string>"))
    one = F.from_json(F.to_json(raw), "map<string,string>")
    entries = F.when(F.schema_of_variant(raw).startswith("ARRAY"), F.flatten(F.transform(listed, lambda m: F.map_entries(m)))).otherwise(F.map_entries(one))
    return F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>"))


def routing_items(tiles: DataFrame) -> DataFrame:
    """link_id, kind (parametric, point), item_no, direction, range_start, range_end, attrs: equal items of a link once.

    attrs is an array of (key, value). Items are numbered in tile order.
    """
    t = _each(tiles, "$.link_attribution", "a").withColumn("link_id", _id(get("a", "$.link_local_ref"))).where("link_id is not null")
    parts = []
    for kind, items, payload in (("parametric", "$.parametric_attribution", "$.link_parametric_attribution"), ("point", "$.point_attribution", "$.link_point_attribution")):
        p = t.select("tile_no", "no", "link_id", F.posexplode(get("a", items, "array<variant>")).alias("k", "i"))
        parts.append(p.select("link_id", F.lit(kind).alias("kind"), F.struct("tile_no", "no", "k").alias("at"), get("i", "$.applies_to_direction").alias("direction"), get("i", "$.applies_to_range.range_offset_from_start", "double").alias("range_start"),
                              get("i", "$.applies_to_range.range_offset_from_end", "double").alias("range_end"), _payload("i", payload).alias("attrs")))
    rows = reduce(DataFrame.unionByName, parts)
    body = F.xxhash64("kind", "direction", "range_start", "range_end", F.to_json("attrs"))
    rows = rows.groupBy("link_id", body.alias("_k")).agg(F.min_by(F.struct("kind", "at", "direction", "range_start", "range_end", "attrs"), "at").alias("r")).select("link_id", "r.*")
    from pyspark.sql.window import Window

    return rows.withColumn("item_no", F.row_number().over(Window.partitionBy("link_id").orderBy("kind", "at"))).drop("at")


def dotted(rows: DataFrame, key: str = "key", raw: str = "raw") -> DataFrame:
    """``rows`` with each JSON object in ``raw`` taken apart into rows of its leaves, keys joined by dots; other values stay as they are."""
    nested = F.col(raw).startswith("{")

    def leaves(k: str, value) -> list[tuple[str, str]]:
        out = []
        for name, v in value.items():
            out += leaves(f"{k}.{name}", v) if isinstance(v, dict) else [] if v is None else [(f"{k}.{name}", v if isinstance(v, str) else json.dumps(v))]
        return out

    def split(keys: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([[{"key": a, "value": b} for a, b in leaves(k, json.loads(v))] for k, v in zip(keys, values, strict=True)])

    parts = F.pandas_udf(split, "array<struct<key:string,value:string>>")(F.col(key), F.col(raw))
    rest = [c for c in rows.columns if c not in (key, raw)]
    apart = rows.where(nested).withColumn("_e", F.explode(parts)).select(*rest, F.col("_e.key").alias(key), F.col("_e.value").alias(raw))
    return rows.where(~nested).select(*rest, key, raw).unionByName(apart)


def attribute_values(items: DataFrame) -> DataFrame:
    """link_id, item_no, key, value (canonical): functional classes as FC_n, lists as several values, the leaves of nested objects under dotted keys."""
    e = items.select("link_id", "item_no", F.explode("attrs").alias("e")).select("link_id", "item_no", "e.key", F.col("e.value").alias("raw")).where("raw is not null")
    e = dotted(e)
    many = F.when(F.col("raw").startswith("["), F.from_json("raw", "array<string>")).otherwise(F.array("raw"))
    e = e.select("link_id", "item_no", "key", F.explode(many).alias("raw"))
    number = F.col("raw").try_cast("double")
    n = F.when(number == F.floor(number), F.floor(number).cast("bigint").cast("string")).otherwise(number.cast("string"))
    value = F.when((F.col("key") == "functional_class") & number.isNotNull(), F.concat(F.lit('"FC_'), n, F.lit('"'))).when(F.col("raw") == "true", "1").when(F.col("raw") == "false", "0").when(number.isNotNull(), n).otherwise(F.concat(F.lit('"'), F.col("raw"), F.lit('"')))
    return e.select("link_id", "item_no", "key", value.alias("value"))


def strands(tiles: DataFrame) -> DataFrame:
    """strand_id, first_link_id, first_link_orientation, additional_links, attrs; equal ones once."""
    t = _each(tiles, "$.strand_attribution", "s")
    more = F.transform(get("s", "$.additional_link_refs", "array<variant>"), lambda a: F.struct(
        F.try_variant_get(a, "$.additional_link_refs.link_id", "string").alias("link_id"), F.try_variant_get(a, "$.additional_link_refs.link_here_tile_id", "string").alias("tile_id"), F.try_variant_get(a, "$.link_orientation_in_strand", "string").alias("orientation")))
    t = t.select("tile_no", "no", get("s", "$.strand_attribution_id.strand_attribution_id").alias("strand_id"), _id(get("s", "$.first_link_id")).alias("first_link_id"), get("s", "$.first_link_orientation_in_strand").alias("first_link_orientation"),
                 more.alias("additional_links"), _payload("s", "$.strand_attribution").alias("attrs"))
    body = [c for c in t.columns if c not in ("tile_no", "no")]
    return t.groupBy(F.xxhash64(F.to_json(F.struct(*body))).alias("_k")).agg(F.min_by(F.struct(*body), F.struct("tile_no", "no")).alias("r")).select("r.*")


def lane_geometry(tiles: DataFrame) -> dict[str, DataFrame]:
    """reference, lanes and boundaries: lane_group_ref, number, lat, lon, alt_cm of all tiles together."""
    g = _each(_with_centre(tiles), "$.lane_group_geometries", "g").withColumn("v", F.col("g")).withColumn("group_no", F.col("no")).drop("no", "g")
    group = get("v", "$.lane_group_ref")
    path = ("$.here_2d_coordinate_diffs", "$.cm_from_wgs84_ellipsoid_diffs")

    def lines(items: str, shape: str | None, number: str) -> DataFrame:
        x = _each(g, items, "x")
        line = F.when(F.col("centre").isNotNull(), get("x", shape, "variant")).otherwise(F.col("x")) if shape else F.col("x")
        x = x.withColumn("line", line).where("line is not null")
        lat, lon, alt = _decoded("line", *path)
        return x.select("tile_no", F.coalesce(get("x", "$.lane_group_ref"), group).alias("lane_group_ref"), F.coalesce(get("x", f"$.{number}", "int"), F.col("no")).alias("number"),
                        get("x", "$.left_lane_boundary_number", "int").alias("left_boundary"), get("x", "$.right_lane_boundary_number", "int").alias("right_boundary"), lat.alias("lat"), lon.alias("lon"), alt.alias("alt_cm"))

    one = g.withColumn("line", get("v", "$.reference_geometry", "variant")).where("line is not null and centre is not null")
    lat, lon, alt = _decoded("line", *path)
    raw_ref = one.select("tile_no", group.alias("lane_group_ref"), lat.alias("lat"), lon.alias("lon"), alt.alias("alt_cm"))
    ref = lines("$.reference_geometry", None, "none").select(*raw_ref.columns)
    return {"reference": raw_ref.unionByName(ref), "lanes": lines("$.lane_geometries", "$.lane_path_geometry", "lane_number"), "boundaries": lines("$.lane_boundary_geometries", "$.geometry", "lane_boundary_number")}


def lane_topology(tiles: DataFrame) -> DataFrame:
    """lane_group_id, start and end connector ids, length_m, lanes (start, end, no from 1); groups without an id are UNKNOWN_n."""
    t = _each(tiles, "$.lane_groups_starting_in_tile", "g")
    end = F.coalesce(get("g", "$.end_lane_group_connector_ref.lane_group_connector_id"), get("g", "$.end_lane_group_connector_ref"))
    lanes = F.transform(get("g", "$.lanes", "array<variant>"), lambda x, k: F.struct(F.try_variant_get(x, "$.start_lane_connector_number", "int").alias("start"), F.try_variant_get(x, "$.end_lane_connector_number", "int").alias("end"), (k + 1).alias("no")))
    return t.select("tile_no", F.coalesce(_id(get("g", "$.lane_group_id")), F.concat(F.lit("UNKNOWN_"), F.col("no"))).alias("lane_group_id"), _id(get("g", "$.start_lane_group_connector_ref")).alias("start_connector_id"), _id(end).alias("end_connector_id"),
                    get("g", "$.lane_group_length_meters", "double").alias("length_m"), F.coalesce(lanes, F.array().cast("array<struct<start:int,end:int,no:int>>")).alias("lanes"))


def lane_attribute_items(tiles: DataFrame) -> DataFrame:
    """group_id, lane_no, direction, lane_type, width_profile, in_intersection, s0, s1: one row a parametric item, two for an item of both directions.

    A direction is FORWARD or BACKWARD, or its number (4 for both); others are null. An item is in an intersection if it says anything about it.
    """
    t = _each(tiles, "$.lane_group_attribution", "g").select(_group_id().alias("group_id"), F.explode(get("g", "$.lane_attribution", "array<variant>")).alias("l"))
    t = t.select("group_id", get("l", "$.lane_number", "int").alias("lane_no"), F.explode(get("l", "$.parametric_attribution", "array<variant>")).alias("p"))
    a = F.explode_outer(F.coalesce(get("p", "$.lane_parametric_attribution", "array<variant>"), F.array(get("p", "$.lane_parametric_attribution", "variant")))).alias("a")
    t = t.select("group_id", "lane_no", "p", a)
    raw = F.upper(get("a", "$.direction_of_travel"))
    words = (F.when(raw.isin("FORWARD", "2"), F.array(F.lit("FORWARD"))).when(raw.isin("BACKWARD", "3"), F.array(F.lit("BACKWARD")))
             .when(raw == "4", F.array(F.lit("FORWARD"), F.lit("BACKWARD"))))
    r = _range_of("p")
    t = t.select("group_id", "lane_no", "p", "a", F.explode_outer(words).alias("direction"))
    return t.select("group_id", "lane_no", "direction", get("a", "$.lane_type").alias("lane_type"), get("a", "$.lane_width_profile").alias("width_profile"),
                    get("a", "$.lane_within_intersection", "variant").isNotNull().alias("in_intersection"), r["s0"].alias("s0"), r["s1"].alias("s1"))


def _group_id():
    return _id(F.coalesce(get("g", "$.lane_group_ref.lane_group_id"), get("g", "$.lane_group_ref")))


def _range_of(v: str) -> Column:
    from wayloom.operators.attributes import range_of

    return range_of(*[get(v, f"$.applies_to_range.{k}") for k in ("start", "end", "range_offset_from_start", "range_offset_from_end")])


def boundary_marking_items(tiles: DataFrame) -> DataFrame:
    """group_id, boundary_no, s0, s1, marking (its JSON): one row a marking of a lane group's boundary.

    A boundary's parametric attribution counts, and its point attribution where that is missing or empty. Boundaries without a number
    and items without a marking have no row; equal markings are kept as often as they are said.
    """
    t = _each(tiles, "$.lane_group_attribution", "g").select(_group_id().alias("group_id"), F.explode(get("g", "$.lane_boundary_attribution", "array<variant>")).alias("b"))
    said, else_ = (get("b", f"$.{k}", "array<variant>") for k in ("parametric_attribution", "lane_boundary_point_attribution"))
    t = t.select("group_id", get("b", "$.lane_boundary_number", "int").alias("boundary_no"), F.explode(F.when(F.size(said) > 0, said).otherwise(else_)).alias("p"))
    items = "$.lane_boundary_parametric_attribution"
    t = t.select("group_id", "boundary_no", "p", F.explode(F.coalesce(get("p", items, "array<variant>"), F.array(get("p", items, "variant")))).alias("a"))
    r = _range_of("p")
    t = t.select("group_id", "boundary_no", r["s0"].alias("s0"), r["s1"].alias("s1"), F.to_json(get("a", "$.lane_boundary_marking", "variant")).alias("marking"))
    return t.where("group_id <> '' and boundary_no is not null and marking <> 'null'")


def group_parameter_items(tiles: DataFrame) -> DataFrame:
    """group_id, s0, s1, parameter (its JSON): one row a parametric item of a whole lane group, as often as it is said."""
    t = _each(tiles, "$.lane_group_attribution", "g").select(_group_id().alias("group_id"), F.explode(get("g", "$.parametric_attribution", "array<variant>")).alias("p"))
    t = t.select("group_id", "p", F.explode(get("p", "$.lane_group_parametric_attribution", "array<variant>")).alias("a"))
    r = _range_of("p")
    return t.select("group_id", r["s0"].alias("s0"), r["s1"].alias("s1"), F.to_json("a").alias("parameter")).where("group_id <> ''")


def link_rows(links: DataFrame, lat0: float, lon0: float, h0: float = 0.0) -> DataFrame:
    """link_id, u, v, points: projected to metres around the origin, at most 64 points each; links without both ends are left out."""
    from wayloom.functions.polyline import finite_points, subsample

    xy = geodesy.project_polyline(F.col("lat"), F.col("lon"), F.array(F.lit(0)), F.lit(lat0), F.lit(lon0), F.lit(h0))
    return links.where("start_node_id is not null and end_node_id is not null").select(
        "link_id", F.col("start_node_id").alias("u"), F.col("end_node_id").alias("v"), F.when(F.size("lat") == F.size("lon"), subsample(finite_points(xy))).otherwise(F.array().cast("array<struct<x:double,y:double>>")).alias("points"))
