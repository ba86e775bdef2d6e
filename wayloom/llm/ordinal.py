"""Quality grades by ordinal cumulative-link regression (operator 9).

Graded ratings come from the labels: 0 for low quality, 1 for good quality that
is toxic, 2 for good quality that isn't. One weight vector over hashed text
features is shared by all grades, and ordered thresholds cut its score:

    P(grade >= k) = 1 / (1 + exp(-(w x - t_k))),  t_1 <= t_2

Features are the frequencies of hashed words and of hashed word shapes (the
kinds of a word's first two and last three characters).

The model is fitted on the driver to at most ``max_labelled`` labelled rows
(by hash of the doc_id); all texts are scored whole where they lie. Null or
empty texts have no features and get the thresholds' own probabilities, and
aren't kept. Repeated rows are scored alike; labels that repeat a doc_id count
with their least grade, and of rated rows that repeat a doc_id the least text
is learnt from, in the order of the ids, so the fit neither grows with repeated
rows nor depends on where they lie. Without two different grades all texts get the prior.
Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.words import LOWER, blocks, flat_list, hash_spans, run_sums, spans

WORDS, SHAPES = 1 << 15, 1 << 12
_SHAPE = np.arange(256, dtype=np.int64)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def block_features(a: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, shape bucket) of every word, and each text's first word."""
    starts, ends, first = spans(a, off)
    word = (hash_spans(run_sums(LOWER[a]), starts, ends) % np.uint64(WORDS)).astype(np.int64)
    c, last = _SHAPE[a] if len(a) else np.zeros(1, np.int64), ends - 1
    key = np.zeros(len(starts), np.int64)
    for at in (starts, np.minimum(starts + 1, last), np.maximum(last - 2, starts), np.maximum(last - 1, starts), last):
        key = (key * 263 + c[at]) % 1_000_003
    return word, WORDS + key % SHAPES, first


def fit(grade: np.ndarray, index: np.ndarray, value: np.ndarray, count: np.ndarray, grades: int, steps: int = 300, rate: float = 0.3, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by full-batch Adam on the log likelihood; thresholds are a first and positive steps."""
    rows = np.repeat(np.arange(len(grade)), count)
    dim, n = WORDS + SHAPES, len(grade)
    tail = np.array([(grade >= k).mean() for k in range(1, grades)]).clip(1e-3, 1 - 1e-3)
    t = -np.log(tail / (1 - tail))
    raw = np.append(t[0], np.log(np.maximum(np.diff(t), 1e-3)))
    w = np.zeros(dim)
    m, v = np.zeros(dim + len(raw)), np.zeros(dim + len(raw))
    for step in range(1, steps + 1):
        t = np.cumsum(np.append(raw[0], np.exp(raw[1:])))
        z = np.bincount(rows, weights=w[index] * value, minlength=n)
        p = 1 / (1 + np.exp(-(z[:, None] - t[None, :]).clip(-30, 30)))  # P(grade >= k)
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        like = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-9)
        d = p * (1 - p)
        dt = np.zeros((n, grades - 1))
        up, lo = np.flatnonzero(grade > 0), np.flatnonzero(grade < grades - 1)
        dt[up, grade[up] - 1] += d[up, grade[up] - 1] / like[up]
        dt[lo, grade[lo]] -= d[lo, grade[lo]] / like[lo]
        gz = -dt.sum(axis=1) / n
        gt = dt.sum(axis=0) / n
        graw = np.append(gt.sum(), [np.exp(raw[k]) * gt[k:].sum() for k in range(1, len(raw))])
        g = np.append(np.bincount(index, weights=value * np.repeat(gz, count), minlength=dim) + l2 * w, graw)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        w -= move[:dim]
        raw -= 0.1 * move[dim:]
    return w, np.cumsum(np.append(raw[0], np.exp(raw[1:])))


def graded(labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return (labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade"))
            .groupBy("doc_id").agg(F.min("grade").alias("grade")))


def ordinal_quality(docs: DataFrame, ratings: DataFrame, grades: int = 3, keep_at: int = 1, least: float = 0.5, max_labelled: int = 12_000) -> DataFrame:
    """doc_id, expected_grade, tail_1 ... (P(grade >= k)), kept: a row for each row of ``docs`` (doc_id, text).

    ``ratings`` has doc_id and grade (0 to grades - 1); kept: P(grade >= keep_at) is at least ``least``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = ratings.select("doc_id", "grade").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def rows(batches):
        for batch in batches:
            own, grade, keep, index, value, count = batch.column("doc_id").to_pylist(), batch.column("grade").to_pylist(), [], [], [], []
            for i, j, a, off in blocks(batch.column("text")):
                word, shape, first = block_features(a, off)
                for k in range(j - i):
                    s, e = first[k], first[k + 1]
                    if e > s:
                        u, c = np.unique(np.concatenate([word[s:e], shape[s:e]]), return_counts=True)
                        keep.append((own[i + k], grade[i + k]))
                        index.append(u.astype(np.int32))
                        value.append((c / (e - s)).astype(np.float32))
                        count.append(len(u))
            if count:
                at, keep = zip(*keep, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(keep, pa.int32()), flat_list(np.concatenate(index), np.array(count), pa.int32()), flat_list(np.concatenate(value), np.array(count), pa.float32())], names=["doc_id", "grade", "i", "v"])

    rated = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # at most max_labelled rows
    got = rated.mapInArrow(rows, "doc_id long, grade int, i array<int>, v array<float>").toArrow().sort_by("doc_id")
    grade = got.column("grade").to_numpy() if got.num_rows else np.zeros(0, np.int32)
    if len(np.unique(grade)) > 1:
        flat, vals = got.column("i").combine_chunks(), got.column("v").combine_chunks()
        w, t = fit(grade, flat.flatten().to_numpy(), vals.flatten().to_numpy().astype(float), np.array([len(x) for x in flat]), grades)
    else:
        w, t = np.zeros(WORDS + SHAPES), np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(1)
    w = w.astype(np.float32)

    def run(batches):
        for batch in batches:
            z, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, j, a, off in blocks(batch.column("text")):
                word, shape, first = block_features(a, off)
                total = np.append(0.0, np.cumsum(w[word].astype(float) + w[shape]))
                n[i:j] = np.diff(first)
                z[i:j] = (total[first[1:]] - total[first[:-1]]) / np.maximum(n[i:j], 1)
            p = 1 / (1 + np.exp(-(z[:, None] - t[None, :]).clip(-50, 50)))
            cols = [batch.column("doc_id"), pa.array(p.sum(axis=1)), *(pa.array(p[:, k]) for k in range(grades - 1)), pa.array((p[:, keep_at - 1] >= least) & (n > 0))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "expected_grade", *(f"tail_{k}" for k in range(1, grades)), "kept"])

    tails = "".join(f"tail_{k} double, " for k in range(1, grades))
    return docs.mapInArrow(run, f"doc_id long, expected_grade double, {tails}kept boolean")
