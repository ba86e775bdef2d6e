"""Toxicity with noisy-channel deobfuscation (operator 5).

1. A character trigram model is counted over all texts.
2. Words that look written around a filter (digits or signs among letters, a
   letter three times and more, letters set apart by spaces or marks) become a
   lattice: each character may stand for itself or for letters it resembles,
   marks and repetitions may be noise. The Viterbi path, the least sum of the
   model's and the channel's costs, is the restored word.
3. Words and beginnings of words of the restored texts whose presence speaks
   for the label are learnt from labelled rows, as log odds; near copies in the
   labelled sample count once. A word counts by the strongest of them, a text by
   the sum over the different ones that it has, and a logistic curve fitted to the
   sums of the sample turns that into the score.

Labels are read only from rows whose crc32(doc_id as text) mod 5 isn't 0, and
only from ``max_labelled`` of them (by hash of the doc_id); lang, source and
doc_id aren't inputs of a score. Null or empty texts have no words and get the
score of the bias. A row without a doc_id is not held out. Repeated rows are
scored alike. Without labels of either kind no word is learnt. Other columns
aren't read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.words import LOWER, blocks, flat_list, grams, hash_spans, run_sums, sequence_hash, signed, spans, string_hash

#: Letters that a character may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "*": "aeiou"}
SEPARATORS = ".-_*~'`,:;/\\"
_OTHER, _EDGE, N = 26, 27, 28
_CLASS = np.full(256, _EDGE, np.int64)
_CLASS[97:123] = np.arange(26)
_CLASS[128:] = _OTHER
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_SOLID = _LETTER.copy()
_SOLID[48:58] = True
_LEADS, _TRAILS = (np.isin(np.arange(256), [ord(c) for c in s]) for s in ("$@!|", "$@"))
#: Lengths, in bytes, of the beginnings of longer words that are features beside the words.
PREFIXES = (4, 5, 6, 7)
SUBSTITUTE, COLLAPSE, DELETE, KEEP_SIGN = 0.7, 0.4, 0.4, 3.0


def trigram_costs(docs: DataFrame) -> np.ndarray:
    """-log p(c | a, b) as an array of 28 * 28 * 28; the counts are over all texts and of fixed size."""

    def run(batches):
        count = np.zeros(N**3, np.int64)
        for batch in batches:
            for _, _, a, _ in blocks(batch.column("text")):
                c = _CLASS[LOWER[a]].astype(np.int32)
                if len(c) > 2:
                    count += np.bincount(c[:-2] * (N * N) + c[1:-1] * N + c[2:], minlength=N**3)
        k = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(count[k])], names=["k", "n"])

    count = np.zeros(N**3)
    for r in docs.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        count[r.k] = r.n
    count = count.reshape(N, N, N) + 0.05
    return -np.log(count / count.sum(axis=2, keepdims=True))


def _kind(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else _OTHER if c.isalpha() else _EDGE


def restore_word(word: str, cost: np.ndarray) -> str:
    """The Viterbi path through the lattice of one lower-cased word."""
    # state: the last two letters' classes; value: (cost, letters)
    states = {(_EDGE, _EDGE): (0.0, "")}
    for i, c in enumerate(word):
        ways: list[tuple[str, float]] = []
        if c.isalpha():
            ways.append((c, 0.0))
            if i and word[i - 1] == c:
                ways.append(("", COLLAPSE))
        else:
            ways += [(x, SUBSTITUTE) for x in LOOKALIKES.get(c, "")]
            if c in SEPARATORS:
                ways.append(("", DELETE))
            ways.append((c, KEEP_SIGN))
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (x, y), (total, out) in states.items():
            for letter, price in ways:
                if letter:
                    k = _kind(letter)
                    state, value = (y, k), total + price + cost[x, y, k]
                else:
                    state, value = (x, y), total + price
                if state not in after or value < after[state][0]:
                    after[state] = (value, out + letter)
        states = after
    return min((total + cost[x, y, _EDGE], out) for (x, y), (total, out) in states.items())[1]


class Restorer:
    """Restored words of blocks of texts; equal words are decoded once."""

    def __init__(self, cost: np.ndarray):
        self.cost, self.seen = cost, {}

    def hashes(self, word: str, parts: bool) -> list[np.ndarray]:
        """Features of the restored word, and with ``parts`` of its inner words of 4 letters and more: an array each."""
        key = (word, parts)
        if key not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            s = restore_word(word, self.cost)
            got = {s.encode()}
            if parts:
                got |= {s[i:j].encode() for i in range(len(s)) for j in range(i + 4, min(len(s), i + 16) + 1)}
            got = sorted(got - {b""})
            if parts:
                self.seen[key] = [string_hash([w]) for w in got]
            else:
                self.seen[key] = [np.concatenate([string_hash([w]), *(string_hash([w[:p]]) ^ np.uint64(p) for p in PREFIXES if len(w) > p)]) for w in got]
        return self.seen[key]

    def words(self, a: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[tuple[int, np.ndarray]]]:
        """(hashes of plain words, each text's first, beginnings as (words, hashes) for each length, restored words as (text, features))."""
        a = LOWER[a]
        starts, ends, first = spans(a, off)
        solid = np.append(np.flatnonzero(_SOLID[a]), len(a))
        at = np.searchsorted(solid, starts)
        s = solid[at]
        e = solid[np.maximum(np.searchsorted(solid, ends) - 1, 0)] + 1
        has = (s < ends) & (e > s)
        s, e = np.where(has, s, starts), np.where(has, e, starts)
        letters = np.append(0, np.cumsum(_LETTER[a]))
        n_letters = letters[e] - letters[s]
        triple = np.zeros(len(a) + 1, np.int64)
        if len(a) > 2:
            triple[3:] = np.cumsum((a[2:] == a[1:-1]) & (a[1:-1] == a[:-2]) & _LETTER[a[2:]])
        odd = has & (n_letters >= 1) & (e - s > n_letters) & (n_letters * 2 >= e - s - 1)
        odd |= has & (triple[e] - triple[np.minimum(s + 2, e)] > 0)
        lead = has & (s - starts == 1) & _LEADS[a[np.maximum(s - 1, 0)]] & (n_letters > 1)
        trail = has & (ends - e == 1) & _TRAILS[a[np.minimum(e, max(len(a) - 1, 0))]] & (n_letters > 1) if len(a) else has
        odd |= lead | trail
        out = []
        of = np.repeat(np.arange(len(off) - 1), np.diff(first))
        for k in np.flatnonzero(odd):
            x, y = (starts[k] if lead[k] else s[k]), (ends[k] if trail[k] else e[k])
            out += [(int(of[k]), x) for x in self.hashes(a[x:y].tobytes().decode("utf-8", "replace"), False)]
        single = ends - starts == 1
        single &= _SOLID[a[starts]] | _LEADS[a[starts]] if len(a) else single
        run = np.append(np.append(False, single), False)
        lo, hi = np.flatnonzero(run[1:] & ~run[:-1]), np.flatnonzero(~run[1:] & run[:-1])
        for x, y in zip(lo[hi - lo >= 4], hi[hi - lo >= 4], strict=True):
            for k in np.unique(of[x:y]):
                own = a[starts[x:y][of[x:y] == k]].tobytes().decode("utf-8", "replace")
                if len(own) >= 4:
                    out += [(int(k), x) for x in self.hashes(own, True)]
        total, starts_of = run_sums(a), []
        for p in PREFIXES:
            long = np.flatnonzero(e - s > p)
            starts_of.append((long, hash_spans(total, s[long], s[long] + p) ^ np.uint64(p)))
        return hash_spans(total, s, e), first, starts_of, out


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


class Lexicon:
    """Features with weights, and sums of texts."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray):
        order = np.argsort(feature)
        self.feature, self.weight = feature[order], np.append(weight[order], 0.0)  # the last: none

    def find(self, h: np.ndarray) -> np.ndarray:
        n = len(self.feature)
        if not n:
            return np.zeros(len(h), np.int64)
        k = np.minimum(np.searchsorted(self.feature, h), n - 1)
        return np.where(self.feature[k] == h, k, n)

    def sums(self, r: Restorer, a: np.ndarray, off: np.ndarray) -> np.ndarray:
        h, first, begins, more = r.words(a, off)
        n = len(self.feature)
        best = self.find(h)
        for long, x in begins:
            k = self.find(x)
            up = self.weight[k] > self.weight[best[long]]
            best[long[up]] = k[up]
        at = np.flatnonzero(best < n)
        pair = [(np.searchsorted(first, at, "right") - 1) * (n + 1) + best[at]]
        for text, x in more:
            k = self.find(x)
            top = k[np.argmax(self.weight[k])]
            pair.append(np.array([text * (n + 1) + top] if top < n else [], np.int64))
        both = np.unique(np.concatenate(pair).astype(np.int64))
        return np.bincount(both // (n + 1), weights=self.weight[both % (n + 1)], minlength=len(off) - 1)


def logistic_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(a, b) of p = 1 / (1 + exp(-(a + b x))) for weighted points, b at least 0, by Newton steps with a light pull to 0."""
    a, b = math.log((n[y == 1].sum() + 0.5) / (n[y == 0].sum() + 1.0)), 0.0
    scale = max(1.0, float(x.max(initial=0)))
    u = x / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * u, -40, 40)))
        g = np.array([(n * (y - p)).sum(), (n * (y - p) * u).sum() - 1e-2 * b])
        w = n * p * (1 - p)
        hess = np.array([[w.sum() + 1e-6, (w * u).sum()], [(w * u).sum(), (w * u * u).sum() + 1e-2]])
        step = np.clip(np.linalg.solve(hess, g), -5, 5)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return (a, b / scale) if b > 0 else (math.log((n[y == 1].sum() + 0.5) / (n[y == 0].sum() + 1.0)), 0.0)


def labelled_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """text, toxic of at most ``max_labelled`` rows that may be learnt from."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # at most max_labelled rows of 12 bytes
    return docs.join(F.broadcast(known), "doc_id").select("text", "toxic")


def learn(sample: DataFrame, cost: np.ndarray) -> Lexicon:
    def run(batches):
        r = Restorer(cost)
        for batch in batches:
            toxic, sig, flat, count, tox = batch.column("toxic").to_pylist(), [], [], [], []
            for i, j, a, off in blocks(batch.column("text")):
                h, first, begins, more = r.words(a, off)
                extra: dict[int, list] = {}
                for k, x in more:
                    extra.setdefault(k, []).append(x)
                cuts = [np.searchsorted(long, first) for long, _ in begins]
                g = grams(h, 5)
                for k in range(j - i):
                    s, e = first[k], first[k + 1]
                    if e == s:
                        continue
                    u = np.unique(np.concatenate([h[s:e], *(x[c[k] : c[k + 1]] for (_, x), c in zip(begins, cuts, strict=True)), *extra.get(k, [])]))
                    sig.append(int(g[s : e - 4].min() >> np.uint64(1)) if e - s >= 5 else sequence_hash(h[s:e]) >> 1)
                    flat.append(u)
                    count.append(len(u))
                    tox.append(toxic[i + k])
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(tox, pa.int32()), flat_list(signed(np.concatenate(flat)), np.array(count), pa.int64())], names=["sig", "toxic", "words"])

    once = sample.mapInArrow(run, "sig long, toxic int, words array<long>").groupBy("sig", "toxic").agg(F.min("words").alias("words"))
    word = F.explode(F.concat(F.array(F.lit(0).cast("long")), "words"))  # 0 counts the texts
    df = once.select("toxic", word.alias("w")).groupBy("w").agg(F.sum("toxic").alias("d1"), F.sum(1 - F.col("toxic")).alias("d0"))
    n = df.where("w = 0").first()
    if not n or not n.d1 or not n.d0:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    p1, p0 = (F.col("d1") + 0.5) / (n.d1 + 1.0), (F.col("d0") + 0.5) / (n.d0 + 1.0)
    weight = F.log(p1 / (1 - p1)) - F.log(p0 / (1 - p0))
    # in at least 1 in 100 of the toxic texts: at most as many rows as a hundred such texts have features
    rows = df.where(F.col("w") != 0).where(F.col("d1") >= max(5, 0.01 * n.d1)).select("w", weight.alias("x")).where("x >= 2").collect()
    return Lexicon(np.array([r.w for r in rows], np.int64).view(np.uint64), np.array([r.x for r in rows]))


def calibrate(sample: DataFrame, cost: np.ndarray, lexicon: Lexicon) -> tuple[float, float]:
    """The logistic curve of the sample's sums, from a table of them in steps of 0.1."""

    def run(batches):
        r = Restorer(cost)
        for batch in batches:
            x = [np.zeros(0), *(lexicon.sums(r, a, off) for _, _, a, off in blocks(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(np.concatenate(x) * 10).astype(np.int64)), batch.column("toxic")], names=["x", "toxic"])

    rows = sample.mapInArrow(run, "x long, toxic int").groupBy("x", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    x, y, n = (np.array([r[k] for r in rows], float) for k in range(3))
    return logistic_curve(x / 10, np.minimum(y, 1), n)


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cost = trigram_costs(docs)
    sample = labelled_rows(docs, labels, max_labelled)
    lexicon = learn(sample, cost)
    start, slope = calibrate(sample, cost, lexicon)

    def run(batches):
        r = Restorer(cost)
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for i, j, a, off in blocks(batch.column("text")):
                z[i:j] = lexicon.sums(r, a, off)
            score = 1 / (1 + np.exp(-np.clip(start + slope * z, -50, 50)))
            out = np.array([held_out(x) for x in batch.column("doc_id").to_pylist()], bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
