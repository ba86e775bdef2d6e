"""URL filter: host and path rules, then logistic regression on hashed character n-grams (operator 8).

The model is trained on the driver from a small labelled URL table (tab-separated
``label`` and ``url``; 1: block), whose size is bounded by ``max_labelled`` rows; every
page is scored where it lies, from a weight table of fixed size. The features of a URL
are the distinct n-grams of its host and of its path, with marks at both ends and all digits
alike.

Nulls and strings without ``://`` have an empty host and path, fit no rule and
get the model's verdict on a URL without features, its bias. Repeated rows are judged
alike; long URLs are read whole. Other columns aren't read. Empty input gives an empty result.
"""

from __future__ import annotations

import csv
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.words import blocks, mix

BUCKETS = 1 << 16
ORDERS = (3, 4, 5)
BLOCK_BYTES = 1 << 18
#: (host, path, verdict): a rule fits its host and all subdomains.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The labelled table that is used unless a caller names another: invented hosts, both labels with the same endings and paths.
LABELLED = str(Path(__file__).with_name("labelled_urls.tsv"))


def labelled_urls(path: str = LABELLED, max_labelled: int = 100_000) -> list[tuple[str, int]]:
    """(url, label) of a table on the driver's disk; raises if it has more rows than the bound."""
    with open(path, newline="", encoding="utf-8") as f:
        rows = [(r["url"], int(r["label"])) for r in csv.DictReader(f, delimiter="\t")]
    if len(rows) > max_labelled:
        raise ValueError(f"the labelled table is bounded by {max_labelled} rows")
    return rows


def held_out(url: str, parts: int = 5) -> bool:
    """Whether a labelled URL is for measuring: a fifth of the hosts."""
    return zlib.crc32(split_url(url)[0].encode()) % parts == 0


def _tail(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(_tail(url), r"(?s)^[^/?#]*", 0), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_tail(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """Struct(rule, verdict) of the longest rule that fits, or null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # later ones win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    tail = rest[cut:]
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), tail[: min([k for k in (tail.find("?"), tail.find("#")) if k >= 0], default=len(tail))]


def features(host: pa.Array, path: pa.Array, buckets: int = BUCKETS):
    """(first row, end row, row - first row, bucket) of the distinct n-grams of each URL, in blocks of bounded size."""
    marked = pc.binary_join_element_wise("^", host, "$\x00^", path, "$", "")
    for i, j, a, off in blocks(marked, BLOCK_BYTES):
        row = np.repeat(np.arange(j - i), np.diff(off))
        zeros = np.zeros(len(a) + 1, np.int64)
        np.cumsum(a == 0, out=zeros[1:])
        in_path = (zeros[:-1] > zeros[off[:-1]][row]).astype(np.uint64)
        code = a.astype(np.uint64)
        code[(a >= 48) & (a <= 57)] = 48
        found = []
        for n in ORDERS:
            m = len(a) - n + 1
            if m <= 0:
                continue
            ok = np.flatnonzero((row[:m] == row[n - 1 :]) & (zeros[n:] == zeros[:m]))
            g = np.uint64(n) + np.uint64(16) * (in_path[ok] + np.uint64(1))
            for k in range(n):
                g = g * np.uint64(257) + code[ok + k]
            found.append(row[ok].astype(np.uint64) * np.uint64(buckets) + mix(g) % np.uint64(buckets))
        both = np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)
        yield i, j, both // buckets, both % buckets


def scores(host: pa.Array, path: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The model's probability of the label 1."""
    z = np.full(len(host), bias)
    for i, j, row, bucket in features(host, path, len(weights)):
        total = np.bincount(row, weights=weights[bucket], minlength=j - i)
        z[i:j] += total / np.sqrt(np.maximum(np.bincount(row, minlength=j - i), 1))
    return 1 / (1 + np.exp(-z.clip(-50, 50)))


def train(labelled: list[tuple[str, int]], epochs: int = 300, rate: float = 0.3, l2: float = 2e-3, prior: float = 0.5, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps scaled per feature; the same on every run.

    ``prior``: the share that the label 1 has, whatever its share of the table."""
    weights, bias = np.zeros(buckets), 0.0
    y = np.array([t for _, t in labelled], float)
    if len(np.unique(y)) < 2:
        return weights, float(np.sign(y.mean() - 0.5) if len(y) else -1.0)
    parts = [split_url(u) for u, _ in labelled]
    got = list(features(pa.array([h for h, _ in parts]), pa.array([p for _, p in parts]), buckets))
    row = np.concatenate([i + r for i, _, r, _ in got])
    used, bucket = np.unique(np.concatenate([b for *_, b in got]), return_inverse=True)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    each = np.where(y == 1, prior / y.sum(), (1 - prior) / (1 - y).sum())
    w, seen = np.zeros(len(used)), np.full(len(used), 1e-12)
    for _ in range(epochs):
        z = np.bincount(row, weights=w[bucket], minlength=len(y)) * scale + bias
        err = each * (1 / (1 + np.exp(-z)) - y)
        grad = np.bincount(bucket, weights=(err * scale)[row], minlength=len(used)) + l2 / len(y) * w
        seen += grad * grad
        w -= rate * grad / np.sqrt(seen)
        bias -= rate * err.sum()
    weights[used] = w
    return weights, bias


def judge_urls(pages: DataFrame, labelled: str | list[tuple[str, int]] = LABELLED, rules=RULES, threshold: float = 0.5,
               max_labelled: int = 100_000) -> DataFrame:
    """page_id, host, path, rule, verdict, score: a row for each row of ``pages`` (page_id, url).

    ``labelled``: the path of a labelled table, or its (url, label) pairs.
    """
    rows = labelled_urls(labelled, max_labelled) if isinstance(labelled, str) else labelled
    if len(rows) > max_labelled:
        raise ValueError(f"the labelled table is bounded by {max_labelled} rows")
    w, bias = train(rows)
    nonzero = np.flatnonzero(w)
    values = w[nonzero]

    def run(batches):
        weights = np.zeros(BUCKETS)
        weights[nonzero] = values
        for batch in batches:
            score = scores(batch.column("host"), batch.column("path"), weights, bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=["page_id", "host", "path", "score"])

    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    scored = parts.mapInArrow(run, "page_id long, host string, path string, score double")
    hit = rule_column(F.col("host"), F.col("path"))
    own = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumn("hit", hit).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), own).alias("verdict"), "score")
