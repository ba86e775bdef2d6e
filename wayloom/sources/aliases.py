"""Columns of link tables by any of their usual names."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of a link's id, and of its two ends, in order of preference; case doesn't matter.
LINK_ID = ("link_id", "linkId", "link_local_ref", "linkLocalRef", "local_ref", "id")
ENDPOINTS = (("start_node_id", "end_node_id"), ("startNodeId", "endNodeId"), ("start_node", "end_node"), ("from_node_id", "to_node_id"), ("fromNodeId", "toNodeId"),
             ("ref_node_id", "non_ref_node_id"), ("refNodeId", "nonRefNodeId"), ("node0", "node1"), ("source", "target"), ("u", "v"))


def pick_column(columns: Iterable[str], names: Sequence[str]) -> str | None:
    """The column that has the first of the names that any column has."""
    own = {c.lower(): c for c in columns}
    return next((own[n.lower()] for n in names if n.lower() in own), None)


def link_id_column(df: DataFrame) -> str:
    found = pick_column(df.columns, LINK_ID)
    if found is None:
        raise LookupError(f"no link id among {df.columns}")
    return found


def endpoint_columns(df: DataFrame) -> tuple[str, str]:
    for pair in ENDPOINTS:
        a, b = (pick_column(df.columns, [n]) for n in pair)
        if a and b:
            return a, b
    raise LookupError(f"no end nodes among {df.columns}")


def link_ends_table(df: DataFrame) -> DataFrame:
    """link_id, u, v of a link table with any of the names: each end is the first that isn't null of start_node_id, u, from_node_id and the like; rows without both go."""
    first = lambda names: F.coalesce(*(F.col(f"`{c}`") for n in names if (c := pick_column(df.columns, [n])))) if pick_column(df.columns, names) else None
    u, v = first(["start_node_id", "u", "from_node_id"]), first(["end_node_id", "v", "to_node_id"])
    if u is None or v is None:
        a, b = endpoint_columns(df)
        u, v = F.col(f"`{a}`"), F.col(f"`{b}`")
    return df.select(F.col(f"`{link_id_column(df)}`").alias("link_id"), u.alias("u"), v.alias("v")).where("u is not null and v is not null")
