"""Graph-input and junction documents: JSON readers and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.plans.numbering import running_sum, running_sums
from wayloom.plans.scratch import Scratch

GRAPH_SCHEMA, JUNCTION_SCHEMA = "junction_graph_input_v1", "junction_output_v1"
#: The fields of a graph-input document that are read.
GRAPH_FIELDS = """schema string, source_config string, link_ids array<bigint>, row_offsets array<int>, col_indices array<int>, link_type array<int>,
 point_offsets array<int>, point_x array<double>, point_y array<double>, link_plot_x0 array<double>, link_plot_y0 array<double>, link_plot_x1 array<double>, link_plot_y1 array<double>,
 background_link_ids array<bigint>, background_point_offsets array<int>, background_x array<double>, background_y array<double>,
 background_plot_x0 array<double>, background_plot_y0 array<double>, background_plot_x1 array<double>, background_plot_y1 array<double>"""
_POINTS = "array<struct<x:double,y:double>>"
ENDS = ("x0", "y0", "x1", "y1")
#: Items of its rows (the row, its neighbours, its points) after which a part of a document ends; a row is never cut.
PART_ITEMS = 16_384
#: Numbers of the parts behind an array's last row: the end of its offsets, and its bracket.
_TOTAL, _CLOSE = 1 << 62, (1 << 62) + 1


def with_points(links: DataFrame, points: DataFrame) -> DataFrame:
    """``links`` with points: an array of (x, y) by position; empty without any."""
    p = points.groupBy("link_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("_p"))
    xy = F.transform("_p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    return links.join(p, "link_id", "left").withColumn("points", F.coalesce(xy, F.array().cast("array<struct<x:double,y:double>>"))).drop("_p")


def background_edges(links: DataFrame) -> DataFrame:
    """link_id, x0, y0, x1, y1 (first and last point), u, v (2 link, 2 link + 1)."""
    first, last = F.get("points", F.lit(0)), F.try_element_at("points", F.lit(-1))
    return links.where(F.size("points") > 0).select("link_id", first["x"].alias("x0"), first["y"].alias("y0"), last["x"].alias("x1"), last["y"].alias("y1"), (F.col("link_id") * 2).alias("u"), (F.col("link_id") * 2 + 1).alias("v"))


def ragged(offsets, xs, ys, i):
    """Points of item i of a ragged table; empty out of range."""
    lo, hi = F.get(offsets, i), F.get(offsets, i + 1)
    n = F.least(F.size(xs), F.size(ys))
    ok = lo.isNotNull() & hi.isNotNull() & (lo >= 0) & (lo <= hi) & (hi <= n)
    all_ = F.zip_with(xs, ys, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.when(ok, F.slice(all_, F.coalesce(lo, F.lit(0)) + 1, F.greatest(F.coalesce(hi - lo, F.lit(0)), F.lit(0)))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def line_ends(points, unknown: float):
    """The columns x0, y0, x1, y1 of a line's first and last point; ``unknown`` for fewer than two points."""
    first, last = F.get(points, F.lit(0)), F.try_element_at(points, F.lit(-1))
    return [F.when(F.size(points) >= 2, p[c]).otherwise(F.lit(unknown)).alias(c + n) for p, n in ((first, "0"), (last, "1")) for c in ("x", "y")]


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GRAPH_FIELDS).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))


def _checked(d: DataFrame, fits, message: str) -> DataFrame:
    return d.where(F.coalesce(F.assert_true(F.coalesce(fits, F.lit(False)), message).isNull(), F.lit(True)))


def _plot_fits(prefix: str):
    """Without the first array there is nothing to check; with it all four must be there, x and y of a size."""
    x0, y0, x1, y1 = (F.col(f"{prefix}_plot_{c}") for c in ENDS)
    return x0.isNull() | F.coalesce((F.size(x0) == F.size(y0)) & (F.size(x1) == F.size(y1)), F.lit(False))


def _read_ends(prefix: str, by_place: bool) -> list:
    """A row's ends from the plot arrays at ``idx``; from its points without arrays or, ``by_place``, past their end; else 0."""
    own = [F.get(F.col(f"{prefix}_plot_{c}"), F.col("idx")) for c in ENDS]
    n = [F.size(f"{prefix}_plot_{c}") for c in ("x0", "x1")]
    have = F.col(f"{prefix}_plot_x0").isNotNull()
    if by_place:
        have = have & (F.col("idx") < n[0]) & (F.col("idx") < n[1])
    return [F.when(have, o).otherwise(p).alias(c) for o, p, c in zip(own, line_ends(F.col("points"), 0.0), ENDS, strict=True)]


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices: file, idx, link_id, link_type, points, x0, y0, x1, y1; edges: file, src, dst) of graph documents; sizes that don't fit raise.

    x0 to y1 are the ends to plot: the document's, in one without them the first and last point, else 0.
    """
    d = _documents(spark, path)
    n = F.size("link_ids")
    fits = (F.size("row_offsets") == n + 1) & (F.size("link_type") == n) & (F.element_at("row_offsets", -1) == F.size("col_indices")) & (F.size("point_x") == F.size("point_y"))
    d = _checked(_checked(d, fits, "array sizes of a graph document do not fit"), _plot_fits("link"), "plot arrays of a graph document do not fit")
    plot = [f"link_plot_{c}" for c in ENDS]
    v = d.select("file", F.posexplode("link_ids").alias("idx", "link_id"), "link_type", "point_offsets", "point_x", "point_y", *plot)
    v = v.select("file", "idx", "link_id", F.get("link_type", F.col("idx")).alias("link_type"), ragged(F.col("point_offsets"), F.col("point_x"), F.col("point_y"), F.col("idx")).alias("points"), *plot)
    v = v.select("file", "idx", "link_id", "link_type", "points", *_read_ends("link", False))
    e = d.select("file", "link_ids", "row_offsets", "col_indices", F.posexplode("link_ids").alias("idx", "src"))
    lo, hi = F.get("row_offsets", F.col("idx")), F.get("row_offsets", F.col("idx") + 1)
    e = e.select("file", "link_ids", "src", F.explode(F.slice("col_indices", lo + 1, hi - lo)).alias("to"))
    return v, e.select("file", "src", F.get("link_ids", F.col("to")).alias("dst"))


def read_background(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, link_id, points, x0, y0, x1, y1 of the background links of graph documents; none in documents without them."""
    d = _checked(_documents(spark, path), _plot_fits("background"), "plot arrays of a graph document do not fit")
    plot = [f"background_plot_{c}" for c in ENDS]
    ragged_ = ragged(F.col("background_point_offsets"), F.col("background_x"), F.col("background_y"), F.col("idx"))
    b = d.select("file", F.posexplode("background_link_ids").alias("idx", "link_id"), "background_point_offsets", "background_x", "background_y", *plot)
    return b.select("file", "idx", "link_id", ragged_.alias("points"), *plot).select("file", "idx", "link_id", "points", *_read_ends("background", True))


def _ended(rows: DataFrame) -> DataFrame:
    """``rows`` with the ends to plot: their own where given (both nodes known), else those of points; NaN if unknown."""
    if not set(ENDS) <= set(rows.columns):
        return rows.select("*", *line_ends(F.col("points"), float("nan")))
    given = F.lit(True)
    for c in ENDS:
        given = given & F.col(c).isNotNull()
    ends = [F.when(given, F.col(c)).otherwise(p).alias(c) for c, p in zip(ENDS, line_ends(F.col("points"), float("nan")), strict=True)]
    return rows.select(*[c for c in rows.columns if c not in ENDS], *ends)


def _gathered(rows: DataFrame, key: str, sizes: dict[str, str], scratch: Scratch) -> DataFrame:
    """One row: v, the rows in the order of ``key``, each with the running sums (name by array) of its arrays' sizes before it."""
    for name, array in sizes.items():
        rows = running_sum(rows.withColumn("_size", F.size(array)), [F.col(key)], "_size", name, scratch).drop("_size")
    return rows.agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in rows.columns if c != key]))).alias("v"))


def _field(v: str, name: str):
    return F.transform(v, lambda r: r[name])


def _offsets(v: str, before: str, array: str):
    """Where each row's part of a flat array begins, and where the last ends."""
    end = F.try_element_at(v, F.lit(-1))
    return F.concat(_field(v, before), F.array(F.coalesce(end[before] + F.size(end[array]), F.lit(0).cast("long"))))


def _flat(v: str, name: str, part: str | None = None):
    if part is None:
        return F.flatten(_field(v, name))
    return F.flatten(F.transform(v, lambda r: F.transform(r[name], lambda p: p[part])))


def graph_document(rows: DataFrame, source_config: str, background: DataFrame | None = None, ramp_only: bool = True, seconds: float = 0.0, classes: tuple[int, int] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row ``value``, the JSON of a graph document, from (idx, link_id, link_type, neighbours as indices, points).

    Both tables may carry x0, y0, x1, y1, the ends to plot; without them (or with nulls) they are the first and last of two points and
    more. Unknown ends are "NaN" for links; background links (link_id, points), in the order of link_id, are left out without ends.
    ``classes`` are the numbers of secondary and primary ids of the classification, by default those of ``rows``. The format is one object with
    arrays, so this gathers a graph; larger ones are written as tables.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "document")
    if background is None:
        background = spark.createDataFrame([], f"link_id long, points {_POINTS}")
    background = _ended(background).where(~F.isnan("x0") & ~F.isnan("x1"))
    rows = _ended(rows.select("idx", "link_id", "link_type", "neighbours", "points", *[c for c in ENDS if c in rows.columns]))
    d = _gathered(rows, "idx", {"_near": "neighbours", "_at": "points"}, scratch)
    b = _gathered(background.select("link_id", "points", *ENDS), "link_id", {"_at": "points"}, scratch).select(F.col("v").alias("b"))
    both = d.join(F.broadcast(b), F.lit(True))  # two tables of one row
    of_type = lambda k: F.size(F.filter("v", lambda r: r["link_type"] == k))
    second, prime = (of_type(2), of_type(1)) if classes is None else map(F.lit, classes)
    plot = lambda v, prefix: [_field(v, c).alias(f"{prefix}_plot_{c}") for c in ENDS]
    return both.select(F.to_json(F.struct(
        F.lit(GRAPH_SCHEMA).alias("schema"), F.lit(source_config).alias("source_config"),
        F.struct(F.lit(ramp_only).alias("ramp_only"), second.alias("num_secondary_ids"), prime.alias("num_primary_ids")).alias("classification"),
        F.size("v").alias("num_links"), _field("v", "link_id").alias("link_ids"), _offsets("v", "_near", "neighbours").alias("row_offsets"), _flat("v", "neighbours").alias("col_indices"),
        _field("v", "link_type").alias("link_type"), _offsets("v", "_at", "points").alias("point_offsets"), _flat("v", "points", "x").alias("point_x"), _flat("v", "points", "y").alias("point_y"),
        *plot("v", "link"), _field("b", "link_id").alias("background_link_ids"), _offsets("b", "_at", "points").alias("background_point_offsets"),
        _flat("b", "points", "x").alias("background_x"), _flat("b", "points", "y").alias("background_y"), *plot("b", "background"),
        F.struct(F.size("v").alias("num_dual_vertices"), F.size(_flat("v", "neighbours")).alias("num_dual_directed_edges"), F.size("b").alias("num_background_links"), F.lit(seconds).alias("export_time_s")).alias("summary"),
    )).alias("value"))


def _text(items):
    """The items of an array as they stand between its brackets."""
    text = F.to_json(items)
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _array_parts(rows: DataFrame, key: str, fields: list[tuple], scratch: Scratch) -> DataFrame:
    """field, part, first, value of the arrays of one kind of rows: part k of each holds the items of the same rows.

    fields: (number, kind, column, part of a point): "row" an item a row, "flat" the items of an array column, "before" the number
    of such items in the rows before. A part begins with a comma unless it begins the array.
    """
    arrays = list(dict.fromkeys(c for _, kind, c, _ in fields if kind != "row"))
    at = {c: f"_at_{c}" for c in arrays}
    rows = running_sums(rows, [F.col(key)], {"_no": F.lit(1)} | {at[c]: F.size(c) for c in arrays}, scratch)
    part = F.floor(sum((F.col(a) for a in at.values()), F.col("_no")) / PART_ITEMS)
    others = [c for c in rows.columns if c != "_no"]
    # as a column of its own a row waits in its packed form, a fraction of the objects that collect_list would make of its fields
    packed = rows.select(part.alias("part"), F.struct("_no", *others).alias("_row"))
    v = packed.groupBy("part").agg(F.array_sort(F.collect_list("_row")).alias("v"))
    begin = F.get("v", F.lit(0))
    made = []
    for no, kind, c, of in fields:
        name = at[c] if kind == "before" else c
        items = _flat("v", c, of) if kind == "flat" else _field("v", name)
        made.append(F.struct(F.lit(no).alias("field"), (begin[at[c]] if kind == "flat" else begin["_no"]).alias("first"), _text(items).alias("text")))
    out = v.select("part", F.explode(F.array(*made)).alias("f")).select("f.field", "part", "f.first", F.when((F.col("f.first") > 0) & (F.col("f.text") != ""), F.concat(F.lit(","), "f.text")).otherwise(F.col("f.text")).alias("value"))
    return scratch.cut(out, f"parts-{key}")


def _with_ends(background: DataFrame) -> DataFrame:
    """Background links as documents have them: those with ends to plot."""
    return _ended(background).where(~F.isnan("x0") & ~F.isnan("x1")).select("link_id", "points", *ENDS)


def background_parts(background: DataFrame, scratch: Scratch) -> DataFrame:
    """The parts that ``graph_document_parts`` makes of background links (link_id, points), written; they don't depend on its other arrays."""
    return _array_parts(_with_ends(background), "link_id", [(FIELDS.index(f), *how) for f, how in _BACKGROUND_ARRAYS.items()], scratch)


def graph_document_parts(rows: DataFrame, source_config: str, background: DataFrame | None = None, ramp_only: bool = True, seconds: float = 0.0, classes: tuple[int, int] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """field, part, first, value: the document of ``graph_document`` (same arguments) in parts that no task has to hold together.

    The values in the order of field and part, joined without anything between, are the document. ``first`` is the position in its array of
    a part's first item; null for what is not an array's items.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "document")
    if background is None:
        background = spark.createDataFrame([], f"link_id long, points {_POINTS}")
    rows = scratch.cut(_ended(rows.select("idx", "link_id", "link_type", "neighbours", "points", *[c for c in ENDS if c in rows.columns])), "rows")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("link_type") == 2).alias("second"), F.count_if(F.col("link_type") == 1).alias("prime"), F.coalesce(F.sum(F.size("neighbours")), F.lit(0)).alias("near"), F.coalesce(F.sum(F.size("points")), F.lit(0)).alias("points")).first()  # counts
    links = _array_parts(rows, "idx", [(FIELDS.index(f), *how) for f, how in _LINK_ARRAYS.items()], scratch)
    scratch.drop("rows")
    around = background_parts(background, scratch)
    b = _with_ends(background).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("points")), F.lit(0)).alias("points")).first()  # counts
    second, prime = (n.second, n.prime) if classes is None else classes
    head = {"schema": GRAPH_SCHEMA, "source_config": source_config, "classification": {"ramp_only": ramp_only, "num_secondary_ids": second, "num_primary_ids": prime}, "num_links": n.n}
    tail = {"num_dual_vertices": n.n, "num_dual_directed_edges": n.near, "num_background_links": b.n, "export_time_s": seconds}
    frame = [(-1, -1, None, json.dumps(head)[:-1]), (len(FIELDS), -1, None, f', "summary": {json.dumps(tail)}}}')]
    for no, name in enumerate(FIELDS):
        frame += [(no, -1, None, f', "{name}": ['), (no, _CLOSE, None, "]")]
    for name, at, last in (("row_offsets", n.n, n.near), ("point_offsets", n.n, n.points), ("background_point_offsets", b.n, b.points)):
        frame.append((FIELDS.index(name), _TOTAL, at, f"{',' if at else ''}{last}"))
    return links.union(around).union(spark.createDataFrame(frame, "field int, part long, first long, value string"))


#: How each array of a document is made of its rows (see ``_array_parts``).
_LINK_ARRAYS = {"link_ids": ("row", "link_id", None), "row_offsets": ("before", "neighbours", None), "col_indices": ("flat", "neighbours", None), "link_type": ("row", "link_type", None), "point_offsets": ("before", "points", None),
                "point_x": ("flat", "points", "x"), "point_y": ("flat", "points", "y")} | {f"link_plot_{c}": ("row", c, None) for c in ENDS}
_BACKGROUND_ARRAYS = {"background_link_ids": ("row", "link_id", None), "background_point_offsets": ("before", "points", None), "background_x": ("flat", "points", "x"), "background_y": ("flat", "points", "y")} | {
    f"background_plot_{c}": ("row", c, None) for c in ENDS}
FIELDS = [*_LINK_ARRAYS, *_BACKGROUND_ARRAYS]


def _items_of_parts(parts: DataFrame, names: list[str]) -> DataFrame:
    """d, a row for each part: the named arrays' items in it, and ``first_<name>``, where they begin; sizes of a row's arrays that don't fit raise."""
    p = parts.where(F.col("field").isin(*[FIELDS.index(f) for f in names]) & F.col("part").between(0, _TOTAL - 1))
    of = lambda c, f: F.max(F.when(F.col("field") == FIELDS.index(f), F.col(c)))
    p = p.groupBy("part").agg(*[of("value", f).alias(f) for f in names], *[of("first", f).alias(f"first_{f}") for f in names])
    kinds = {k: v for k, v in (f.split() for f in GRAPH_FIELDS.replace("\n", " ").split(","))}
    read = [F.from_json(F.concat(F.lit("["), F.ltrim(F.col(f), F.lit(",")), F.lit("]")), kinds[f]).alias(f) for f in names]
    return p.select(F.struct(*read, *[f"first_{f}" for f in names]).alias("d"))


def _rows_of_parts(parts: DataFrame, names: list[str], per_row: list[str], row) -> DataFrame:
    """The rows of parts: ``row(d, i)`` for row i of a part."""
    fits = lambda d: F.forall(F.array(*[F.size(d[f]) for f in per_row]), lambda n: n == F.size(d[per_row[0]]))
    made = lambda d: F.when(F.coalesce(fits(d), F.lit(False)), F.transform(F.sequence(F.lit(0), F.size(d[per_row[0]]) - 1), lambda i: row(d, i))).otherwise(F.raise_error(F.lit("array sizes of a graph document do not fit")))
    # d is the variable of a loop over one item, so that texts are parsed once and not for each row
    return _items_of_parts(parts, names).select(F.explode(F.flatten(F.transform(F.array("d"), made))).alias("r")).select("r.*")


def graph_rows_of_parts(parts: DataFrame) -> DataFrame:
    """idx, link_id, link_type, row_offset, neighbours, point_offset, x0, y0, x1, y1 of a document in parts."""
    per_row = ["link_ids", "link_type", "row_offsets", "point_offsets", *[f"link_plot_{c}" for c in ENDS]]

    def row(d, i):
        at = F.get(d["row_offsets"], i)
        end = F.coalesce(F.get(d["row_offsets"], i + 1), d["first_col_indices"] + F.size(d["col_indices"]))
        near = F.slice(d["col_indices"], (at - d["first_col_indices"] + 1).cast("int"), (end - at).cast("int"))
        return F.struct((d["first_link_ids"] + i).cast("int").alias("idx"), F.get(d["link_ids"], i).alias("link_id"), F.get(d["link_type"], i).alias("link_type"), at.alias("row_offset"), near.alias("neighbours"),
                        F.get(d["point_offsets"], i).alias("point_offset"), *[F.get(d[f"link_plot_{c}"], i).alias(c) for c in ENDS])

    return _rows_of_parts(parts, [*per_row, "col_indices"], per_row, row)


def background_rows_of_parts(parts: DataFrame) -> DataFrame:
    """link_id, point_offset, x0, y0, x1, y1 of the background links of a document in parts."""
    per_row = ["background_link_ids", "background_point_offsets", *[f"background_plot_{c}" for c in ENDS]]
    row = lambda d, i: F.struct(F.get(d["background_link_ids"], i).alias("link_id"), F.get(d["background_point_offsets"], i).alias("point_offset"), *[F.get(d[f"background_plot_{c}"], i).alias(c) for c in ENDS])
    return _rows_of_parts(parts, per_row, per_row, row)


def plot_lines(rows: DataFrame) -> DataFrame:
    """link_id, points (two: the ends to plot) of rows with x0, y0, x1, y1."""
    end = lambda n: F.struct(F.col("x" + n).alias("x"), F.col("y" + n).alias("y"))
    return rows.select("link_id", F.array(end("0"), end("1")).alias("points"))


def _edge(*more):
    line = F.transform(F.coalesce("points", F.array().cast(_POINTS)), lambda p: F.array(p["x"], p["y"]))
    return F.struct((F.col("link_id") * 2).alias("u"), (F.col("link_id") * 2 + 1).alias("v"), F.col("link_id").alias("here_link_id"), "link_id", *more, line.alias("polyline"))


def _interchanges(junctions: DataFrame, roles: DataFrame, lines: DataFrame) -> DataFrame:
    """junction_id, one: a junction as the documents have it. Links without a row in ``lines`` have no edge; nodes are always empty."""
    e = roles.join(lines.select("link_id", "points"), "link_id").groupBy("junction_id").agg(F.array_sort(F.collect_list(_edge("role"))).alias("edges"))
    none = F.array().cast("array<bigint>")
    j = junctions.join(e, "junction_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)))
    return j.select("junction_id", F.struct(
        F.col("junction_id").alias("id"), "junction_id", "seed_link_id", F.col("secondary_ids").alias("secondary_link_ids"), F.col("primary_ids").alias("primary_boundary_link_ids"),
        F.array_sort(F.array_union("secondary_ids", "primary_ids")).alias("all_link_ids"), F.struct(none.alias("nodes"), "edges").alias("graph")).alias("one"))


def junction_documents(junctions: DataFrame, roles: DataFrame, lines: DataFrame) -> DataFrame:
    """One row ``value`` a junction: ids, members and the edges of its graph with roles and polylines (lines: link_id, points)."""
    return _interchanges(junctions, roles, lines).select("junction_id", F.to_json("one").alias("value"))


def junction_document(junctions: DataFrame, roles: DataFrame, lines: DataFrame, background: DataFrame, vertices: int, directed_edges: int, source_config: str, seconds: float = 0.0, schema: str = JUNCTION_SCHEMA) -> DataFrame:
    """One row ``value``: the summary, all junctions by number and the background links (link_id, points) in one object.

    Gathers all junctions; ``junction_documents`` writes a row each.
    """
    found = _interchanges(junctions, roles, lines).agg(F.array_sort(F.collect_list(F.struct("junction_id", "one"))).alias("j"))
    around = background.agg(F.array_sort(F.collect_list(_edge())).alias("edges"))
    both = found.join(F.broadcast(around), F.lit(True))  # two tables of one row
    return both.select(F.to_json(F.struct(
        F.lit(source_config).alias("source_config"), F.lit(schema).alias("schema"),
        F.struct(F.lit(vertices).alias("num_dual_vertices"), F.lit(directed_edges).alias("num_dual_directed_edges"), F.size("j").alias("num_junctions"), F.lit(seconds).alias("runtime_s")).alias("summary"),
        F.transform("j", lambda x: x["one"]).alias("interchanges"),
        F.struct(F.array().cast("array<bigint>").alias("nodes"), "edges").alias("background_graph"))).alias("value"))
