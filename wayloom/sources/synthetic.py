"""Workload generators: replicated graphs and tile lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the replicas: id stride, metres between copies, copies a row.
ID_STRIDE, SHIFT, COLUMNS = 10**12, 100_000.0, 10


def multiply(links: DataFrame, times: int, ids: tuple[str, ...] = ("link_id", "u", "v"), xs: tuple[str, ...] = ("x",), ys: tuple[str, ...] = ("y",)) -> DataFrame:
    """``times`` copies with shifted ids and places, numbered by ``repeat`` from 0; null and NaN coordinates stay."""
    r = F.col("repeat")
    out = links.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else links.withColumn("repeat", F.lit(0)).limit(0)
    for c in ids:
        out = out.withColumn(c, F.col(c) + r.cast("bigint") * ID_STRIDE)
    for c in xs:
        out = out.withColumn(c, F.col(c) + SHIFT * (r % COLUMNS))
    for c in ys:
        out = out.withColumn(c, F.col(c) + SHIFT * F.floor(r / COLUMNS))
    return out


def common_tiles(folders: list[DataFrame], most: int | None = None) -> DataFrame:
    """Tiles that all folders have, in number order, the first ``most``."""
    tiles = reduce(lambda a, b: a.intersect(b), [f.select("tile") for f in folders]).orderBy(F.col("tile").cast("bigint"))
    return tiles if most is None else tiles.limit(most)


def replicate_graph(vertices: DataFrame, edges: DataFrame, times: int) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of ``times`` disjoint copies."""
    return multiply(vertices, times, ("link_id",)).drop("repeat"), multiply(edges, times, ("src", "dst"), (), ()).drop("repeat")
