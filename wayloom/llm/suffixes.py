"""Substring deduplication by prefix-partitioned suffix trees (operator 10).

A window is 50 consecutive words of one text; a word goes if a window that
covers it also starts in a text with a smaller doc_id.

1. Texts with the same word sequence are one class; its smallest doc_id stays
   in the search and the others lose everything (their windows all start there).
2. The suffixes that are searched start at anchors: of the 8-grams in a window
   the one with the least hash is its anchor, so equal windows have their
   anchors at the same place. A window starts 0 to 42 words before its anchor. The
   windows that start 0 to 21 words before it have 29 words from the anchor on in
   common, the others 22 words before it and 8 from it on: these are the first
   prefixes. Prefixes that are in one text only are done with.
3. The rest are partitioned by prefix. Where a prefix has more suffixes than fit
   into memory, its range of starts is halved, and each half has a longer prefix: what all
   its windows have in common, on both sides of the anchor. So prefixes grow
   until their group fits, up to the whole window of one start, whose tree is a single
   node. Prefixes are packed into groups of bounded size, and each group's
   suffixes, and the words before them, are built into two trees (sorted suffixes
   with the common lengths of neighbours). The nodes at depth 50 - j of the one and
   j of the other are the classes of equal windows that start j words before the anchor.

Suffixes with the same words around them are merged before any of this, so
groups of copies count once. Words are told apart by 32-bit hashes, with the
64-bit hash of the anchor: two different windows would have to differ only in words whose
hashes meet.

Null or empty texts have no words: 0, 0 and the digest of the empty string.
Rows without a doc_id have no smaller or larger one: nothing goes. Rows that
repeat a doc_id are judged each by its own text. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.words import SPACE, blocks, flat_list, grams, hash_spans, inside, run_sums, signed, span_hashes, spans, word_sums
from wayloom.plans.scratch import Scratch

WINDOW, ANCHOR = 50, 8
BEFORE = WINDOW - ANCHOR
#: Starts before the anchor, from and to, of the two first prefixes: words after the anchor, words before it.
SIDES = ((0, BEFORE // 2), (BEFORE // 2 + 1, BEFORE))
#: Segments that leave a task at once.
EMIT = 10_000


def _bits(lo: int, hi: int) -> int:
    return (1 << (hi + 1)) - (1 << lo)


def _slide(x: np.ndarray, n: int, least) -> np.ndarray:
    """Minimum or maximum of each n consecutive values, by doubling."""
    out, width = x, 1
    while 2 * width <= n:
        out = least(out[:-width], out[width:])
        width *= 2
    return out if width == n else least(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])


def anchors(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the anchors of all windows of a block of texts."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64)
    g = grams(h, ANCHOR)
    span = BEFORE + 1
    low = _slide(g, span, np.minimum)  # of each window
    low[~inside(first, WINDOW)] = 0
    pad = np.zeros(BEFORE, np.uint64)
    top = _slide(np.concatenate([pad, low, pad]), span, np.maximum)
    return np.flatnonzero((top == g) & (top > 0))


def prefixes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word in the text, side, key) of the first prefixes of a block of texts, in the order of texts."""
    at = anchors(h, first)
    home = np.searchsorted(first, at, "right") - 1
    total = word_sums(h)
    found = []
    for side, (lo, hi) in enumerate(SIDES):
        ok = np.flatnonzero((at - lo >= first[home]) & (at + WINDOW - hi <= first[home + 1]))
        key = span_hashes(total, at[ok] - lo, at[ok] + WINDOW - hi) ^ np.uint64(side)
        found.append((home[ok], at[ok] - first[home[ok]], np.full(len(ok), side), key))
    text, word, side, key = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(text, kind="stable")
    return text[order], word[order], side[order], key[order]


def _joined(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The kept words of a block of texts, one space between those of a text, and each text's place among these bytes."""
    out = ~SPACE[a]
    gone = np.flatnonzero(~kept)
    edge = np.zeros(len(a) + 1, np.int8)
    edge[starts[gone]] = 1
    edge[ends[gone]] -= 1
    out &= np.cumsum(edge[:-1], dtype=np.int8) == 0
    w = np.flatnonzero(kept)
    home = np.searchsorted(first, w, "right") - 1
    later = w[np.flatnonzero(home[1:] == home[:-1]) + 1]  # all but the first of each text
    body = a.copy()
    body[starts[later] - 1] = 32  # a byte between two words
    out[starts[later] - 1] = True
    length = np.bincount(home, weights=ends[w] - starts[w], minlength=len(first) - 1).astype(np.int64)
    n = np.bincount(home, minlength=len(first) - 1)
    at = np.zeros(len(first), np.int64)
    np.cumsum(length + np.maximum(n - 1, 0), out=at[1:])
    return memoryview(np.ascontiguousarray(body[out])), at


def _digests(a, starts, ends, first, kept) -> list[bytes]:
    body, at = _joined(a, starts, ends, first, kept)
    return [hashlib.sha256(body[i:j]).digest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _scan(batches):
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        words, digest, count, pos, keys = np.zeros(n, np.int64), [], np.zeros(n, np.int64), [], []
        for i, j, a, off in blocks(batch.column("text")):
            starts, ends, first = spans(a, off)
            words[i:j] = np.diff(first)
            home, word, side, key = prefixes(hash_spans(run_sums(a), starts, ends), first)
            count[i:j] = np.bincount(home, minlength=j - i)
            pos.append(2 * word + side)
            keys.append(key)
            digest += _digests(a, starts, ends, first, np.ones(len(starts), bool))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("t"), pa.array(words), pa.array(digest, pa.binary()),
             flat_list(np.concatenate(pos), count, pa.int64()), flat_list(signed(np.concatenate(keys)), count, pa.int64())],
            names=["doc_id", "t", "n_words", "digest", "pos", "keys"])


def _flat(column) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A column of lists of structs as offsets and flat arrays."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = np.asarray(column.offsets).astype(np.int64)
    inner = column.values.slice(off[0], off[-1] - off[0])
    return off - off[0], {f.name: inner.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(inner.type)}


def _runs(h: np.ndarray, start: np.ndarray, length: np.ndarray, step: int) -> pa.Array:
    """A binary column: for each start the big-endian words h[start], h[start + step] and so on."""
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=at[1:])
    within = np.arange(at[-1]) - np.repeat(at[:-1], length)
    body = h[np.repeat(start, length) + step * within]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body))])


def _segments(batches):
    """Around each anchor that is left: the words before it, nearest first, and those from it on, as 32-bit hashes.

    Only words that a window of the anchor's side can have are taken."""
    names = ["key", "doc_id", "t", "pos", "side", "before", "after"]
    lows, highs = np.array(SIDES).T
    for batch in batches:
        if not batch.num_rows:
            continue
        off_hits, hits = _flat(batch.column("hits"))
        ids, ts = batch.column("doc_id").to_numpy(), batch.column("t").to_numpy()
        for i, j, a, off in blocks(batch.column("text")):
            starts, ends, first = spans(a, off)
            h = (hash_spans(run_sums(a), starts, ends) >> np.uint64(32)).astype(">u4")
            for lo in range(int(off_hits[i]), int(off_hits[j]), EMIT):
                part = slice(lo, min(lo + EMIT, int(off_hits[j])))
                row = np.searchsorted(off_hits, np.arange(part.start, part.stop), "right") - 1
                pos, side = hits["pos"][part] >> 1, hits["pos"][part] & 1
                at = first[row - i] + pos
                before = _runs(h, at - 1, np.minimum(pos, highs[side]), -1)
                after = _runs(h, at, np.minimum(first[row - i + 1] - at, WINDOW - lows[side]), 1)
                cols = [pa.array(x, pa.int64()) for x in (hits["key"][part], ids[row], ts[row], pos)]
                cols += [pa.array(side, pa.int32()), before, after]
                yield pa.RecordBatch.from_arrays(cols, names=names)


class PrefixTree:
    """Sorted suffixes of one group and the common lengths of neighbours: a suffix tree in arrays."""

    def __init__(self, prefix: np.ndarray, words: np.ndarray, lengths: np.ndarray):
        m, width = words.shape
        body = np.concatenate([prefix.astype(">u8").reshape(m, 1).view(np.uint8).reshape(m, 8), np.ascontiguousarray(words.astype(">u4")).view(np.uint8).reshape(m, 4 * width)], axis=1)
        self.order = np.argsort(np.ascontiguousarray(body).view(f"V{8 + 4 * width}").reshape(m), kind="stable") if m else np.zeros(0, np.int64)
        x = words[self.order]
        same = x[1:] == x[:-1]
        depth = np.where(same.all(axis=1), width, same.argmin(axis=1)) if width else np.zeros(max(m - 1, 0), np.int64)
        n = lengths[self.order]
        depth = np.minimum(depth, np.minimum(n[1:], n[:-1]))
        p = prefix[self.order]
        self.common = np.where(p[1:] == p[:-1], depth, -1)

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix its node at a depth: suffixes with one prefix and the same words down to there share one."""
        node = np.zeros(len(self.order), np.int64)
        node[self.order[1:]] = np.cumsum(self.common < depth)
        return node


def smaller_starts(prefix: np.ndarray, before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray, doc: np.ndarray,
                   lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bit j of each suffix: the window from j words before it also is in a text with a smaller doc_id (for lo <= j <= hi)."""
    m = len(doc)
    mask = np.zeros(m, np.int64)
    right, left = PrefixTree(prefix, after, n_after), PrefixTree(prefix, before, n_before)
    for j in range(BEFORE + 1):
        ok = np.flatnonzero((n_before >= j) & (n_after >= WINDOW - j) & (lo <= j) & (j <= hi))
        if len(ok) < 2:
            continue
        node = left.nodes(j)[ok] * m + right.nodes(WINDOW - j)[ok]
        order = np.argsort(node, kind="stable")
        head = np.flatnonzero(np.append(True, np.diff(node[order]) > 0))
        least = np.repeat(np.minimum.reduceat(doc[ok][order], head), np.diff(np.append(head, len(ok))))
        hit = ok[order][least < doc[ok][order]]
        mask[hit] |= np.int64(1 << j)
    return mask


def _padded(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = column.to_pylist()
    n = np.array([len(x) // 4 for x in raw], np.int64)
    return np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in raw), ">u4").reshape(len(raw), width), n


def _group(table: pa.Table) -> pa.Table:
    t = table.combine_chunks()
    before, nb = _padded(t.column("before"), BEFORE)
    after, na = _padded(t.column("after"), WINDOW)
    col = lambda c: t.column(c).to_numpy()
    mask = smaller_starts(col("prefix").view(np.uint64), before, nb, after, na, col("d0"), col("lo"), col("hi"))
    keep = np.flatnonzero(mask)
    return pa.table({"key": t.column("key").take(pa.array(keep)), "sid": t.column("sid").take(pa.array(keep)), "mask": pa.array(mask[keep])})


def _apply(batches):
    """Remove the windows of a text; digest what is left."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off_cuts, cuts = _flat(batch.column("cuts"))
        gone, digest = np.zeros(batch.num_rows, np.int64), []
        for i, j, a, off in blocks(batch.column("text")):
            starts, ends, first = spans(a, off)
            edge = np.zeros(len(starts) + 1, np.int64)
            for lo in range(int(off_cuts[i]), int(off_cuts[j]), EMIT):
                part = slice(lo, min(lo + EMIT, int(off_cuts[j])))
                row = np.searchsorted(off_cuts, np.arange(part.start, part.stop), "right") - 1 - i
                at, mask = first[row] + cuts["pos"][part], cuts["mask"][part]
                cut, back = np.nonzero((mask[:, None] >> np.arange(BEFORE + 1)) & 1)
                s = at[cut] - back
                s = s[(s >= first[row[cut]]) & (s + WINDOW <= first[row[cut] + 1])]
                np.add.at(edge, s, 1)
                np.add.at(edge, s + WINDOW, -1)
            out = np.cumsum(edge)[:-1] > 0
            total = np.zeros(len(out) + 1, np.int64)
            np.cumsum(out, out=total[1:])
            gone[i:j] = np.diff(total[first])
            digest += _digests(a, starts, ends, first, ~out)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(gone), pa.array(digest, pa.binary())], names=["doc_id", "t", "gone", "rest"])


def _longer(level: DataFrame) -> DataFrame:
    """Both halves of each suffix's range of starts, by what all windows of a half have in common, where it has one."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))
    level = level.withColumn("half", F.explode(halves)).drop("lo", "hi").select("*", "half.lo", "half.hi").drop("half")
    level = level.where((F.length("before") >= 4 * F.col("lo")) & (F.length("after") >= 4 * (WINDOW - F.col("hi"))))
    parts = (F.col("before").substr(F.lit(1), 4 * F.col("lo")), F.col("after").substr(F.lit(1), 4 * (WINDOW - F.col("hi"))))
    return level.select("key", "sid", "before", "after", "d0", F.xxhash64("key", "lo", "hi", *parts).alias("prefix"), F.xxhash64(F.lit(7), "hi", *parts[::-1]).alias("prefix2"), "lo", "hi")


def window_marks(docs: DataFrame, scratch: Scratch, group_size: int = 20_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scan of all texts, texts with marks to search, marks): a mark (doc_id, t, pos, mask) says which windows around a word go."""
    scan = scratch.cut(docs.select("doc_id", "t", "text").mapInArrow(_scan, "doc_id long, t long, n_words long, digest binary, pos array<long>, keys array<long>"), "scan")
    same = scan.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("d0"))
    same = same.select(F.xxhash64("digest").alias("k2"), F.col("digest").alias("digest2"), "d0")
    scan = scan.withColumn("k", F.xxhash64("digest")).join(same, (F.col("k") == F.col("k2")) & (F.col("digest") == F.col("digest2")), "left").drop("k2", "digest2")
    scan = scratch.cut(scan.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("d0"), F.lit(False))).drop("k"), "classes")
    scratch.drop("scan")
    found = (scan.where(~F.col("copy") & F.col("doc_id").isNotNull() & (F.size("keys") > 0))
             .select("doc_id", "t", F.explode(F.arrays_zip("keys", "pos")).alias("a")).select("doc_id", "t", F.col("a.keys").alias("key"), F.col("a.pos").alias("pos")))
    twice = found.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select(F.xxhash64("key").alias("k"), F.col("key").alias("key2"))
    hits = found.withColumn("k", F.xxhash64("key")).join(twice, "k").where("key = key2")
    hits = hits.groupBy("doc_id", "t").agg(F.collect_list(F.struct("pos", "key")).alias("hits"))
    hits = scratch.cut(hits, "hits")
    texts = docs.select("doc_id", "t", "text")
    texts = scratch.cut(texts.join(hits.hint("shuffle_hash"), ["doc_id", "t"]), "texts")
    scratch.drop("hits")
    seg = texts.mapInArrow(_segments, "key long, doc_id long, t long, pos long, side int, before binary, after binary")
    seg = seg.withColumn("sid", F.xxhash64("before", "after"))
    seg = scratch.cut(seg, "segments")
    merged = seg.groupBy("key", "side", "sid", "before", "after").agg(F.min("doc_id").alias("d0"))
    merged = scratch.cut(merged, "merged")
    level = merged.select("key", "sid", "before", "after", "d0", F.col("key").alias("prefix"), F.lit(0).cast("long").alias("prefix2"), *(F.when(F.col("side") == 0, SIDES[0][k]).otherwise(SIDES[1][k]).alias(n) for k, n in enumerate(("lo", "hi"))))
    parts, depth = [], 0
    while True:
        size = level.groupBy("prefix", "prefix2").agg(F.count(F.lit(1)).alias("size"), F.max("d0").alias("top"), F.min("d0").alias("least")).where("top <> least")
        size = scratch.cut(size.select("prefix", "prefix2", "size", F.expr("size > " + str(group_size)).alias("large"), "least"), f"sizes{depth}")
        level = level.join(size.select("prefix", "prefix2", "large", "least"), ["prefix", "prefix2"])
        counts = size.groupBy("large").agg(F.sum("size").alias("n"))
        n = {r.large: r.n for r in counts.collect()}  # two rows at most
        groups = max(1, -(-n.get(False, 0) // group_size))
        fits = level.where("not large").drop("large", "least")
        if n.get(False):
            parts.append(fits.groupBy(F.pmod(F.xxhash64("prefix"), F.lit(groups)).alias("g")).applyInArrow(_group, "key long, sid long, mask long"))
        if not n.get(True):
            break
        big = level.where("large")
        one = big.where("lo = hi and d0 > least")  # the prefix is the window: one node
        parts.append(one.select("key", "sid", F.expr("shiftleft(1L, lo)").alias("mask")))
        level = scratch.cut(_longer(big.where("lo < hi").drop("prefix", "prefix2", "large", "least")), f"longer{depth}")
        depth += 1
    out = reduce(DataFrame.union, parts) if parts else merged.select("key", "sid", F.lit(0).cast("long").alias("mask")).limit(0)
    masks = scratch.cut(out.groupBy("key", "sid").agg(F.bit_or("mask").alias("mask")), "masks")
    holders = merged.select(F.col("key").alias("key3"), F.col("sid").alias("sid3"), "d0").join(
        masks.select(F.col("key").alias("key3"), F.col("sid").alias("sid3"), "mask"), ["key3", "sid3"], "left")
    holders = holders.groupBy("key3", "sid3").agg(F.min("d0").alias("d0"), F.bit_or("mask").alias("mask")).withColumn("k", F.xxhash64("key3", "sid3"))
    full = F.when(F.col("side") == 0, _bits(*SIDES[0])).otherwise(_bits(*SIDES[1]))
    marks = (seg.select("key", "sid", "doc_id", "t", "pos", "side").withColumn("k", F.xxhash64("key", "sid")).join(holders, "k").where("key = key3 and sid = sid3")
             .select("doc_id", "t", "pos", F.when(F.col("doc_id") > F.col("d0"), full).otherwise(F.coalesce("mask", F.lit(0))).alias("mask")).where("mask <> 0"))
    return scan, texts.select("doc_id", "t", "text"), marks


def drop_repeats(docs: DataFrame, scratch: Scratch | None = None, group_size: int = 20_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row for each row of ``docs`` (doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession, "suffixes")
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    scan, texts, marks = window_marks(docs, scratch, group_size)
    cuts = marks.groupBy("doc_id", "t").agg(F.collect_set(F.struct("pos", "mask")).alias("cuts"))
    done = texts.join(cuts.hint("shuffle_hash"), ["doc_id", "t"]).mapInArrow(_apply, "doc_id long, t long, gone long, rest binary")
    done = scratch.cut(done.dropDuplicates(["doc_id", "t"]), "done")
    full = F.col("copy") & (F.col("n_words") >= WINDOW)
    empty = hashlib.sha256(b"").hexdigest()
    return scan.select("doc_id", "t", "n_words", "digest", "copy").join(done, ["doc_id", "t"], "left").select(
        "doc_id", "n_words", F.when(full, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(full, F.lit(empty)).otherwise(F.lower(F.hex(F.coalesce("rest", "digest")))).alias("kept_sha256"))
