"""The attribute predicate language, compiled to a Column.

    and, or, not, ==, !=, in, not in, constants, true / false / null, names,
    dotted and ['quoted'] paths

Anything else is refused when the text is compiled. Attributes are a column
``map<string, array<string>>`` of canonical values (see ``canonical``): one value
is a scalar, several are the collection that conflicting items leave. A missing
name is null: equal only to null. ``in`` looks into a collection or a text and is an
error on anything else; an error that isn't short-circuited makes the whole
predicate false.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PredicateError(ValueError):
    """The text isn't in the language."""


_WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}


def canonical(value) -> str | None:
    """Texts are quoted; booleans and numbers are numbers, so that 1 equals true."""
    if value is None:
        return None
    if isinstance(value, str):
        return f'"{value}"'
    number = float(value)
    return str(int(number)) if number.is_integer() else repr(number)


def canonical_column(c: Column, kind: str) -> Column:
    if kind == "string":
        return F.concat(F.lit('"'), c, F.lit('"'))
    if kind == "boolean":
        return F.when(c, "1").when(~c, "0")
    number = c.cast("double")
    return F.when(number == F.floor(number), F.floor(number).cast("bigint").cast("string")).otherwise(number.cast("string"))


@dataclass
class _Value:
    """An array of canonical values, or null if missing."""

    col: Column

    @property
    def missing(self) -> Column:
        return self.col.isNull()

    @property
    def scalar(self) -> Column:
        return F.coalesce(F.size(self.col) == 1, F.lit(False))

    @property
    def one(self) -> Column:
        return F.get(self.col, F.lit(0))

    @property
    def text(self) -> Column:
        return self.scalar & F.coalesce(self.one.startswith('"'), F.lit(False))


@dataclass
class _Truth:
    value: Column
    error: Column


class _Compiler:
    def __init__(self, attrs: Column):
        self.attrs = attrs
        self.names: set[str] = set()

    def truth(self, node: ast.AST) -> _Truth:
        if isinstance(node, ast.BoolOp):
            out = self.truth(node.values[0])
            for other in node.values[1:]:
                b = self.truth(other)
                if isinstance(node.op, ast.And):
                    out = _Truth(out.value & b.value, out.error | (out.value & b.error))
                else:
                    out = _Truth(out.value | b.value, out.error | (~out.value & b.error))
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            a = self.truth(node.operand)
            return _Truth(~a.value, a.error)
        if isinstance(node, ast.Compare):
            if len(node.ops) != 1:
                raise PredicateError("comparisons can't be chained")
            a, b, op = self.value(node.left), self.value(node.comparators[0]), node.ops[0]
            if isinstance(op, ast.Eq | ast.NotEq):
                same = F.when(a.missing | b.missing, a.missing & b.missing).otherwise(F.coalesce((F.size(a.col) == F.size(b.col)) & (F.size(F.array_except(a.col, b.col)) == 0), F.lit(False)))
                return _Truth(same if isinstance(op, ast.Eq) else ~same, F.lit(False))
            if isinstance(op, ast.In | ast.NotIn):
                member = F.coalesce(F.array_contains(b.col, a.one), F.lit(False)) & a.scalar
                part = F.contains(b.one.substr(F.lit(2), F.length(b.one) - 2), a.one.substr(F.lit(2), F.length(a.one) - 2))
                many = F.coalesce(F.size(b.col) > 1, F.lit(False))
                found = F.when(many, member).when(a.text & b.text, F.coalesce(part, F.lit(False))).otherwise(F.lit(False))
                return _Truth(found if isinstance(op, ast.In) else ~found, ~(many | (a.text & b.text)))
            raise PredicateError(f"{type(op).__name__} isn't in the language")
        v = self.value(node)
        empty = v.one.isin("0", '""')
        return _Truth(F.when(v.missing, False).when(v.scalar, ~empty).otherwise(F.size(v.col) > 0), F.lit(False))

    def value(self, node: ast.AST) -> _Value:
        if isinstance(node, ast.Constant):
            if not isinstance(node.value, str | int | float | bool | None.__class__):
                raise PredicateError("constants are texts, numbers, true, false and null")
            c = canonical(node.value)
            return _Value(F.lit(None).cast("array<string>") if c is None else F.array(F.lit(c)))
        if isinstance(node, ast.Name) and node.id in _WORDS:
            return self.value(ast.Constant(_WORDS[node.id]))
        name = self.path(node)
        self.names.add(name)
        return _Value(F.try_element_at(self.attrs, F.lit(name)))

    def path(self, node: ast.AST) -> str:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            return f"{self.path(node.value)}.{node.attr}"
        if isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            return f"{self.path(node.value)}.{node.slice.value}"
        raise PredicateError(f"{type(node).__name__} isn't in the language")


def compile_predicate(text: str, attrs: str = "attrs") -> tuple[Column, set[str]]:
    """(boolean Column, never null; the names it reads)."""
    try:
        tree = ast.parse(text, mode="eval")
    except (SyntaxError, ValueError) as e:
        raise PredicateError(str(e)) from e
    c = _Compiler(F.col(attrs))
    t = c.truth(tree.body)
    known = F.coalesce(F.size(F.map_keys(F.col(attrs))) > 0, F.lit(False))
    return F.coalesce(t.value & ~t.error, F.lit(False)) & known, c.names


def item_values(items: DataFrame, keys: dict[str, str]) -> DataFrame:
    """link_id, item_no, key, value (canonical) from typed columns; nulls are left out."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), canonical_column(F.col(k), kind).alias("value")) for k, kind in keys.items()])
    return items.select("link_id", "item_no", F.explode(entries).alias("e")).select("link_id", "item_no", "e.key", "e.value").where("value is not null")


def attribute_union(values: DataFrame, by: tuple[str, ...] = ("link_id",)) -> DataFrame:
    """``by``, attrs: the values of all items together; equal ones collapse."""
    per = values.groupBy(*by, "key").agg(F.array_sort(F.collect_set("value")).alias("vals"))
    return per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("key", "vals"))).alias("attrs"))


def select_links(values: DataFrame, text: str, mode: str = "link_union") -> DataFrame:
    """link_id of links that the predicate takes: over all of a link's items together, or with ``any_item`` by one item alone."""
    test, names = compile_predicate(text)
    if mode == "link_union":
        # values of names that the predicate doesn't read only show that a link has attributes
        slim = values.withColumn("value", F.when(F.col("key").isin(*names), F.col("value")).otherwise(F.lit("1"))) if names else values
        return attribute_union(slim).where(test).select("link_id")
    if mode == "any_item":
        return attribute_union(values, ("link_id", "item_no")).where(test).select("link_id").distinct()
    raise ValueError(f"unknown mode {mode}")
