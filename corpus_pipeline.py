"""A training corpus from documents: five stages, each written and read again as the next one's input.

What all stages do with odd rows: only the columns of ``documents`` are read, so others, whatever
their names, neither clash nor stay. An empty table gives an empty one. Texts are read whole.

* quality rules: a null or empty text has under 10 words and goes; rows that repeat are judged alike, all
  of them; a row without doc_id, lang or source is judged as any other.
* near-dedup: rows without doc_id stay; of rows that repeat a doc_id the least text stays; of equal
  texts the smallest doc_id stays.
* decontamination: a row goes if its doc_id has a leak (so do all rows with that doc_id); rows without
  doc_id stay; null and empty items and texts leak nothing.
* PII: null texts stay null, equal texts become equal texts.
* mix: every row, with or without doc_id and repeated or not, has its own draw; texts without words are
  never drawn; ties in rank are broken by doc_id, size and row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.fertility import passing
from wayloom.llm.leaks import without_leaks
from wayloom.llm.mixing import pareto_mix
from wayloom.llm.oddsketch import one_of_each
from wayloom.llm.pseudonyms import pseudonymise
from wayloom.plans.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share this part of their shingles at least; op2_odd_sketches has a threshold of its own.
NEAR = (80, 100)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passing(docs.select(COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs.select(COLUMNS), link=NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonymise(docs.select(COLUMNS)).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each row as often as it was drawn, numbered by ``copy``; rows without a doc_id or that repeat one have their own draws."""
    rows = Scratch(spark, "mix").cut(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")  # written, so that a row keeps its number
    drawn = pareto_mix(rows, carry=("_row",)).where("copies > 0").select("_row", "copies").hint("shuffle_hash")
    copies = rows.join(drawn, "_row").drop("_row")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("PII", pseudonymise_pii), ("mixing sources to target weights", mix_sources)]

#: The tokeniser, the sketches and the alignment have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.cut(docs, f"stage{k}")
            if k:
                scratch.drop(f"stage{k - 1}")
    return docs
