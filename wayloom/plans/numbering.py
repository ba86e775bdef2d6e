"""Running numbers over a total order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.plans.scratch import Scratch


def number_rows(df: DataFrame, keys: list[Column], name: str, scratch: Scratch, start: int = 1) -> DataFrame:
    """``df`` with ``name``: its rows' numbers in the order of ``keys`` (which should tell rows apart).

    Rows are dealt into ranges, numbered within each, and moved up by the number
    of rows in the ranges before: only one count per range is looked at.
    """
    ranged = df.select("*", F.struct(*keys).alias("_key")).repartitionByRange("_key").withColumn("_part", F.spark_partition_id())
    ranged = scratch.cut(ranged, f"ranged-{name}")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_p2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    out = ranged.withColumn("_row", within).join(F.broadcast(offsets), F.col("_part") == F.col("_p2"))  # a row per partition
    return out.withColumn(name, F.col("_off") + F.col("_row") + (start - 1)).drop("_key", "_part", "_p2", "_off", "_row")


def running_sums(df: DataFrame, keys: list[Column], values: dict[str, Column], scratch: Scratch) -> DataFrame:
    """``df`` with a column for each of ``values``: its sum over the rows before, in the order of ``keys``; dealt into ranges as by ``number_rows``."""
    part = F.spark_partition_id().alias("_part")
    ranged = df.select("*", F.struct(*keys).alias("_key"), *[v.alias(f"_v_{c}") for c, v in values.items()]).repartitionByRange("_key").select("*", part)
    ranged = scratch.cut(ranged, f"ranged-{'-'.join(values)}")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(*[F.sum(f"_v_{c}").alias(f"_n_{c}") for c in values])
    offsets = sums.select(F.col("_part").alias("_p2"), *[F.coalesce(F.sum(f"_n_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in values])
    own = Window.partitionBy("_part").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(f"_v_{c}").over(own), F.lit(0)).alias(f"_row_{c}") for c in values]).join(F.broadcast(offsets), F.col("_part") == F.col("_p2"))  # a row per partition
    return out.select(*[c for c in df.columns if c not in values], *[(F.col(f"_off_{c}") + F.col(f"_row_{c}")).alias(c) for c in values])


def running_sum(df: DataFrame, keys: list[Column], value: str, name: str, scratch: Scratch) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before, in the order of ``keys``."""
    return running_sums(df, keys, {name: F.col(value)}, scratch)
