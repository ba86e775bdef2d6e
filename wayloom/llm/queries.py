"""The registered queries of this folder, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm.pseudonyms import pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents"))


def op2_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm.oddsketch import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm.fertility import fertility_rules

    return fertility_rules(_table(spark, sf_dir, "documents"))


def op4_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm.mixing import pareto_mix

    mixed = pareto_mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm.ngramlm import ngram_scores

    return ngram_scores(_table(spark, sf_dir, "documents"))


def op7_rare_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm.leaks import leaked_passages

    return leaked_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_url_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm.urls import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op9_ordinal_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm.ordinal import graded, ordinal_quality

    return ordinal_quality(_table(spark, sf_dir, "documents"), graded(_table(spark, sf_dir, "labels")))


def op10_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm.suffixes import drop_repeats

    return drop_repeats(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


#: Words of whole texts; the pattern is the one of the operators.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Twins of the two operators whose whole result is fixed: exact set and window joins. The others hold a model, a key or a draw.
SQL: dict[str, str] = {
    "op2_odd_sketches": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
place AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS sh FROM place),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.doc_id = m.c AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id""",
    "op10_prefix_suffix_trees": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
lo AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN lo USING (k) WHERE lo < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS v FROM w),
kept AS (SELECT word.doc_id, string_agg(v, ' ' ORDER BY word.j) AS t, count(*) AS n FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.j WHERE gone.j IS NULL GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
}
