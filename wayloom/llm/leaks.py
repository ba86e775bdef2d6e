"""Benchmark decontamination by rare seeds and local alignment (operator 7).

Test items are the query set: they are taken in blocks of at most
``block_items``, and each block is held against every passage of the training
texts. A seed is a word n-gram of an item that chance would hardly repeat:
its expected count in the whole corpus, from the corpus frequencies of its
words, is low. (The n-gram's own count isn't used: a leaked item makes its own
n-grams frequent.) Each seed found in a text fixes an item and a place;
nearby places of an item are one passage, which Smith-Waterman alignment of
words scores against the item. Edited and paraphrased copies keep some seeds
and lose only part of the score.

Words are compared without case (over Unicode; the sharp s is a double s) and
without the marks at their ends. Texts are read whole. Null or empty texts and items have no words and no leaks; items
with fewer words than a seed are aligned from their whole sequence as one
seed. Repeated rows give their own result rows. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.words import LOWER, blocks, hash_spans, run_sums, spans

SEED = 3
_MARK = np.ones(256, bool)
_MARK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_MUL = np.uint64(0xD1342543DE82EF95)


def folded(text) -> F.Column:
    """Text without case, accented letters included."""
    return F.replace(F.lower(text.cast("string")), F.lit("\u00df"), F.lit("ss"))


def plain_words(a: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without outer marks, and each text's first word."""
    a = LOWER[a]
    starts, ends, first = spans(a, off)
    solid = np.append(np.flatnonzero(~_MARK[a]), len(a))
    s = solid[np.searchsorted(solid, starts)]
    back = np.append(-1, solid[:-1])
    e = back[np.searchsorted(back, ends, "left") - 1] + 1
    ok = s < e
    ok &= s < ends
    s, e = np.where(ok, s, starts), np.where(ok, e, starts)
    h = hash_spans(run_sums(a), s, e)
    keep = np.flatnonzero(ok)
    return h[keep], np.searchsorted(keep, first)


def seeds_of(h: np.ndarray, n: int) -> np.ndarray:
    m = len(h) - n + 1
    g = np.zeros(max(m, 0), np.uint64)
    for k in range(n):
        g *= _MUL
        g += h[k : k + m]
    g ^= g >> np.uint64(29)
    return g


def align(item: np.ndarray, text: np.ndarray, match: int = 2, miss: int = -1, gap: int = -1) -> tuple[int, int, int, int]:
    """Smith-Waterman over words: (score, item words matched, start, end of the text's part).

    One row of the matrix is held: each cell carries where its best way began and how many words it has
    matched, so memory follows the text's length alone. Of equal ways a pair of words goes before a gap.
    """
    n = len(text)
    at = np.arange(n + 1)
    ramp = at * gap
    score, matched, begin = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), at.copy()
    best = (0, 0, 0, 0)
    for word in item:
        eq = text == word
        pair = score[:-1] + np.where(eq, match, miss)
        row = np.maximum(score + gap, 0)
        row[0] = 0
        np.maximum(row[1:], pair, out=row[1:])
        new = np.maximum.accumulate(row - ramp) + ramp  # gaps in the item: a running maximum
        paired = pair == new[1:]
        m, b = matched.copy(), begin.copy()
        m[1:] = np.where(paired, matched[:-1] + eq, matched[1:])
        b[1:] = np.where(paired, begin[:-1], begin[1:])
        m[new == 0], b[new == 0] = 0, at[new == 0]
        source = np.maximum.accumulate(np.where(row == new, at, 0))  # where the gap before a cell begins
        score, matched, begin = new, m[source], b[source]
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(matched[j]), int(begin[j]), j)
    return best


def word_counts(docs: DataFrame, wanted: np.ndarray) -> tuple[dict[int, int], int]:
    """Corpus counts of the wanted words (a block's vocabulary, bounded by it) and of all words."""

    def run(batches):
        c, total = np.zeros(len(wanted), np.int64), 0
        for batch in batches:
            for _, _, a, off in blocks(batch.column("text")):
                h, _ = plain_words(a, off)
                total += len(h)
                if len(wanted) and len(h):
                    k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    c += np.bincount(k[wanted[k] == h], minlength=len(wanted))
        hit = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1), pa.int64()), pa.array(np.append(c[hit], total), pa.int64())], names=["k", "c"])

    got = docs.mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()
    counts = {r.k: r.c for r in got}
    return counts, counts.pop(-1, 0)


def leaked_passages(docs: DataFrame, items: DataFrame, n: int = SEED, chance: float = 1e-3, least: float = 0.5,
                    least_words: int = 8, block_items: int = 20_000, margin: int = 12) -> DataFrame:
    """doc_id, item_id, score, share, matched, first_word, n_words: every leak, best passage per (doc_id, item_id).

    ``chance``: a seed's expected count per 10,000 words of corpus at most.
    ``least``: the alignment's score over the item's best possible score.
    ``docs`` has doc_id, text; ``items`` has item_id, text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), folded(F.col("text")).alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), folded(F.col("text")).alias("text")).where("text is not null")
    total = items.count()
    n_blocks = max(1, -(-total // block_items))
    found = None
    for b in range(n_blocks):  # a stated query set, in blocks of bounded size
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
        hits = _block(docs, part.collect(), n, chance, least, least_words, margin)
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else spark.createDataFrame([], SCHEMA)


SCHEMA = "doc_id long, item_id long, score int, share double, matched int, first_word long, n_words int"


def _block(docs, rows, n, chance, least, least_words, margin):
    words, ids = [], []
    for r in rows:
        a = np.frombuffer(r.text.encode(), np.uint8)
        h, _ = plain_words(a, np.array([0, len(a)]))
        if len(h):
            words.append(h)
            ids.append(r.item_id)
    wanted = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    counts, total = word_counts(docs, wanted)
    p = np.array([max(counts.get(k, 0), 1) for k in range(len(wanted))], float) / max(total, 1)
    seed, home, place = [], [], []
    for k, h in enumerate(words):
        own = min(n, len(h))
        g = seeds_of(h, own) ^ np.uint64(own)
        odds = np.ones(len(g))
        for j in range(own):
            odds *= p[np.searchsorted(wanted, h[j : j + len(g)])]
        rare = np.flatnonzero(odds * 1e4 <= chance)
        if len(rare) < 4:  # an item of common words alone keeps its rarest seeds
            rare = np.sort(np.argsort(odds, kind="stable")[: max(4, len(g) // 4)])
        seed.append(g[rare])
        home.append(np.full(len(rare), k))
        place.append(rare)
    seed = np.concatenate(seed) if seed else np.zeros(0, np.uint64)
    home = np.concatenate(home) if home else np.zeros(0, np.int64)
    place = np.concatenate(place) if place else np.zeros(0, np.int64)
    order = np.argsort(seed, kind="stable")
    seed, home, place = seed[order], home[order], place[order]
    lengths = sorted({min(n, len(h)) for h in words})

    def passages(h: np.ndarray):
        """(item, text words from, to) around the seeds in one text."""
        at, row = [], []
        for own in lengths:
            g = seeds_of(h, own) ^ np.uint64(own)
            lo = np.searchsorted(seed, g, "left")
            lo = np.minimum(lo, len(seed) - 1)
            hit = np.flatnonzero(seed[lo] == g)
            if len(hit):
                hi = np.searchsorted(seed, g[hit], "right")
                count = hi - lo[hit]
                at.append(np.repeat(hit, count))
                row.append(np.repeat(lo[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        if not at:
            return
        at, row = np.concatenate(at), np.concatenate(row)
        item = home[row]
        start = at - place[row]  # where the item would begin
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        cut = np.flatnonzero((item[1:] != item[:-1]) | (start[1:] - start[:-1] > margin)) + 1
        for s, e in zip(np.append(0, cut), np.append(cut, len(item)), strict=True):
            k = int(item[s])
            yield k, max(0, int(start[s]) - margin), min(len(h), int(start[e - 1]) + len(words[k]) + margin)

    def run(batches):
        for batch in batches:
            doc_id = batch.column("doc_id").to_pylist()
            out = []
            for i, _, a, off in blocks(batch.column("text")):
                if not len(seed):
                    break
                h, first = plain_words(a, off)
                # texts without any seed are passed over at once
                any_hit = np.zeros(len(h) + 1, np.int64)
                for own in lengths:
                    g = seeds_of(h, own) ^ np.uint64(own)
                    any_hit[: len(g)] += seed[np.minimum(np.searchsorted(seed, g), len(seed) - 1)] == g
                run_ = np.append(0, np.cumsum(any_hit[:-1]))
                for k in np.flatnonzero(run_[first[1:]] > run_[first[:-1]]):
                    own = h[first[k] : first[k + 1]]
                    best = {}
                    for item, s, e in passages(own):
                        score, matched, x, y = align(words[item], own[s:e])
                        if score > best.get(item, (0,))[0]:
                            best[item] = (score, matched, s + x, y - x)
                    for item, (score, matched, s, length) in sorted(best.items()):
                        share = score / (2 * len(words[item]))
                        if share >= least and matched >= min(least_words, len(words[item])):
                            out.append((doc_id[i + k], ids[item], score, share, matched, s, length))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int32()), strict=True)],
                names=["doc_id", "item_id", "score", "share", "matched", "first_word", "n_words"])

    return docs.mapInArrow(run, SCHEMA)


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with no leaked passage; rows without doc_id stay."""
    bad = leaked_passages(docs, items, **options).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
