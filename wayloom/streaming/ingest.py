"""Incremental link classification, an extension: new routing items as a stream, counts of the links they touch per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def link_items(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of Parquet files of items that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(items: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window_start, link_type, n_items per tumbling window; items later than ``late`` are left out, so state is bounded."""
    w = items.withWatermark(time, late).groupBy(F.window(time, width), "link_type").agg(F.count(F.lit(1)).alias("n_items"))
    return w.select(F.col("window.start").alias("window_start"), "link_type", "n_items")


def to_table(stream: DataFrame, folder: str, checkpoint: str):
    """Append to a Parquet table, each batch once, until the input is used up."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
