"""Operators 4, 7 and 9 against plain forms: row-by-row Pareto ranks, exhaustive alignment, numeric slopes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def mixed(rows, weights, copies, key):
    """taken words of each row (doc_id, source, size), one source after the other, row by row."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s))
    size = {s: sum(n for _, t, n in rows if t == s) for s in sources}
    w = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), float(sum(size.values()))
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= copies * size[s]}
        if not full:
            target.update({s: w[s] * level for s in open_})
            break
        target.update({s: float(copies * size[s]) for s in full})
        left -= sum(target[s] for s in full)
        open_ -= full
    out = {}
    for s in sources:
        own = [(d, n) for d, t, n in rows if t == s]
        whole = int(target[s] // size[s]) if size[s] else 0
        rest = target[s] - whole * size[s]
        damped = sum(n / (n + 1) ** 0.25 for _, n in own)

        def rank(d, n):
            u = (int(hashlib.md5(f"{key}:{d}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            p = min(max(rest / damped / (n + 1) ** 0.25 if damped else 0.0, 1e-6), 1 - 1e-6)
            return (u / (1 - u)) / (p / (1 - p))

        run = 0
        for d, n in sorted(own, key=lambda r: (rank(*r), r[0])):
            run += n
            drawn = n > 0 and rest > 0 and run - n / 2 <= rest
            out[d] = n * min(copies, whole + drawn)
    return out


@pytest.mark.parametrize("bins", [1, 3, 4096])
def test_mix_is_the_plain_ranking(spark, bins):
    from wayloom.llm.mixing import pareto_mix

    r = random.Random(6)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", "d", None]), r.choice([0, 1, 5, 40, 900])) for i in range(700)]
    docs = spark.createDataFrame([(d, s, "w " * n) for d, s, n in rows], "doc_id long, source string, text string")
    got = {x.doc_id: x.taken for x in pareto_mix(docs, bins=bins).collect()}
    assert got == mixed(rows, (5, 2, 1), 3, "mix-1")


@pytest.mark.parametrize("vocabulary, least", [(3000, 1.0), (60, 0.9)])
def test_seeds_find_what_whole_alignment_finds(spark, vocabulary, least):
    """Copies with a tenth to three tenths of the words dropped, put in or replaced, beside unrelated texts."""
    from wayloom.llm.leaks import align, leaked_passages

    r = random.Random(vocabulary)
    word = lambda: f"w{r.randrange(vocabulary)}x"
    items = [[word() for _ in range(40)] for _ in range(30)]
    texts = []
    for i in range(150):
        q, rate = [], (0.1, 0.2, 0.3)[i % 3]
        for x in items[r.randrange(30)] if i % 5 else []:
            kind = r.randrange(3) if r.random() < rate else 3
            q += [[], [x, word()], [word()], [x]][kind]
        texts.append([word() for _ in range(r.randrange(60))] + q + [word() for _ in range(r.randrange(60))])
    code = {w: k for k, w in enumerate(sorted({w for t in [*items, *texts] for w in t}))}
    number = lambda t: np.array([code[w] for w in t], np.int64)
    want = set()
    for d, t in enumerate(texts):
        for k, q in enumerate(items):
            score, matched, _, _ = align(number(q), number(t))
            if score / 80 >= 0.5 and matched >= 8:
                want.add((d, k))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(q)) for k, q in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in leaked_passages(docs, bench).collect()}
    assert got <= want and len(want) > 80 and len(got) >= least * len(want)


def test_long_items_align_in_little_memory():
    import tracemalloc

    from wayloom.llm.leaks import align

    r = np.random.default_rng(3)
    item = r.integers(0, 1 << 40, 600)
    text = np.concatenate([r.integers(0, 1 << 40, 100_000), item[:300], [1, 2], item[300:]])
    tracemalloc.start()
    got = align(item, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == (1198, 600, 100_000, 100_602) and peak < 30 << 20


def test_ordinal_fit_is_at_a_flat_place():
    from wayloom.llm.ordinal import fit

    r = np.random.default_rng(5)
    x = r.random((400, 4))
    grade = np.digitize(x @ [4, -3, 2, 0] + r.logistic(size=400) * 0.7, [0.8, 2.2])

    def loss(w, t):
        p = 1 / (1 + np.exp(-((x @ w)[:, None] - t[None, :])))
        full = np.concatenate([np.ones((400, 1)), p, np.zeros((400, 1))], axis=1)
        return -np.log(full[np.arange(400), grade] - full[np.arange(400), grade + 1]).mean() + 0.5e-5 * (w @ w)

    w, t = fit(grade, np.tile(np.arange(4, dtype=np.int32), 400), x.ravel(), np.full(400, 4), 3, steps=3000, rate=0.05)
    w, h = w[:4], 1e-5
    slope = [(loss(w + h * e, t) - loss(w - h * e, t)) / (2 * h) for e in np.eye(4)] + [(loss(w, t + h * e) - loss(w, t - h * e)) / (2 * h) for e in np.eye(2)]
    assert np.abs(slope).max() < 1e-3 and t[0] < t[1] and w[0] > 2 and w[1] < -1


def test_ordinal_rows_that_repeat(spark):
    from wayloom.llm.ordinal import ordinal_quality

    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["good", "bad"][i % 2 :: 2] + ["the", "of", "x%"]) for _ in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 2 * 2) for i in range(60)], "doc_id long, grade int")
    once = {x.doc_id: x.expected_grade for x in ordinal_quality(docs, ratings).collect()}
    again = docs.unionByName(docs.where("doc_id < 9")).repartition(7, F.col("text"))
    twice = ordinal_quality(again, ratings).collect()
    assert len(twice) == 69 and all(abs(once[x.doc_id] - x.expected_grade) < 1e-12 for x in twice)
