"""Mixing sources to target weights by Pareto order sampling (operator 4).

Every source has a target of words. A document first gets the certain whole
copies that its source's ratio of target to size contains; the rest of the
target is a sample without replacement: document i draws u from its keyed
hash and ranks by (u / (1 - u)) / (p / (1 - p)), the random odds over its
inclusion odds, and documents are taken from the smallest rank on until the
words of the rest are reached. Inclusion probabilities differ: they fall with
the fourth root of the size, so that few very long texts don't make up a
sample.

Only sums move between machines. Ranks are cut into bins, and bins into as
many finer ones; a source's words by bin show the bin in which its sample
ends, those of that bin's parts the part, and only that part, one in
``bins`` ** 2, is ranked row by row.

Rows with a null text or no words have size 0 and take 0. Sources are ordered
by code point with null last. Rows that repeat a doc_id draw the same u and
are told apart by size. Empty input gives empty output. Columns other than
doc_id, source, text and those of ``carry`` aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.plans.scratch import Scratch

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
MAX_COPIES = 3


def uniform(key: str, doc_id: Column) -> Column:
    """A number strictly between 0 and 1 from the first 48 bits of a keyed digest."""
    digest = F.md5(F.concat(F.lit(f"{key}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(by_source: DataFrame, weights: tuple[float, ...], copies: int) -> DataFrame:
    """source, source_size, weight, target from (source, source_size).

    With weights w and caps c the level L with sum(min(c, L w)) = total is found
    from sources in order of c / w: those before it are capped.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    t = (by_source.withColumn("weight", pick)
         .withColumn("cap", (F.col("source_size") * copies).cast("double"))
         .withColumn("ratio", F.col("cap") / F.col("weight")))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    t = (t.withColumn("total", F.sum("source_size").over(whole).cast("double"))
         .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open")))
    # the first source, in this order, that the level leaves under its cap sets the level for the rest
    t = t.withColumn("final", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "source", "level"))).over(whole)["level"])
    return t.select("source", "source_size", "weight",
                    F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("cap")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def sized(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(*carry, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def _end(rows: DataFrame, bin_: str, before: Column) -> DataFrame:
    """e_source, e_bin, e_before: the bin in which a source's words, after ``before``, reach its rest, and the words before that bin."""
    known = before.cast("long").alias("before")
    by_bin = rows.groupBy("source", "rest", F.col(bin_).alias("b"), known).agg(F.sum("size").alias("words"))
    run = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("b"))
    return (by_bin.withColumn("until", run).where(F.col("until") >= F.col("rest")).groupBy("source").agg(F.min(F.struct("b", "until", "words")).alias("e"))
            .select(F.col("source").alias("e_source"), F.col("e.b").alias("e_bin"), (F.col("e.until") - F.col("e.words")).alias("e_before")))


def pareto_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), copies: int = MAX_COPIES, key: str = "mix-1",
               bins: int = BINS, scratch: Scratch | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, after the columns ``carry`` of ``docs``: a row for each row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    rows = scratch.cut(sized(docs, carry), "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") / F.sqrt(F.sqrt(F.col("size") + F.lit(1.0)))).alias("damped"))
    damped = by_source.select(F.col("source").alias("s2"), "damped")
    targets = source_targets(by_source.select("source", "source_size"), weights, copies)
    targets = targets.join(damped, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    targets = (targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
               .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    targets = scratch.cut(targets, "targets")
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", "whole", "rest", "damped")
    ranked = rows.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    p = F.col("rest") / F.col("damped") / F.sqrt(F.sqrt(F.col("size") + F.lit(1.0)))
    p = F.least(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(1e-6)), F.lit(1 - 1e-6))
    u = uniform(key, F.col("doc_id"))
    rank = (u / (1 - u)) / (p / (1 - p))
    ranked = ranked.withColumn("rank", rank).withColumn("bin", F.floor(F.col("rank") / (F.col("rank") + 1) * (bins * bins)).cast("long"))
    ranked = scratch.cut(ranked, "ranked")
    drawn_from = ranked.where("size > 0 and rest > 0").select("source", "rest", "size", "bin", F.floor(F.col("bin") / bins).alias("coarse"))
    ends = scratch.cut(_end(drawn_from, "coarse", F.lit(0)), "ends")
    fine = drawn_from.join(ends, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("coarse") == F.col("e_bin")))
    ends = _end(fine, "bin", F.col("e_before"))
    placed = ranked.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left")
    last = placed.where(F.col("bin") == F.col("e_bin")).where("size > 0")
    within = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("drawn", (F.col("e_before") + within - F.col("size") / 2 <= F.col("rest")).cast("long"))
    cols = [*carry, "doc_id", "source", "size", "source_size", "target", "whole", "drawn"]
    others = placed.where(~((F.col("bin").eqNullSafe(F.col("e_bin"))) & (F.col("size") > 0)))
    others = others.withColumn("drawn", ((F.col("rest") > 0) & (F.col("e_bin").isNull() | (F.col("bin") < F.col("e_bin")))).cast("long"))
    out = others.select(cols).unionByName(last.select(cols))
    n = (F.coalesce(F.col("whole"), F.lit(0)) + F.coalesce(F.col("drawn"), F.lit(0)))
    n = F.when(F.col("size") > 0, F.least(n, F.lit(copies))).otherwise(F.lit(0))
    return out.select(*carry, "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target"),
                      n.cast("long").alias("copies"), (n * F.col("size")).cast("long").alias("taken"))
