"""MinHash near-duplicates with odd sketches (operator 2).

A text's set is its distinct 5-word shingles (A-Z lower-cased; with fewer words
the whole sequence; without words nothing). Two texts are linked where the
intersection is at least ``link`` of the union: 85 / 100, unless a caller says
otherwise.

1. Each set gives MinHash samples, band keys over some of them, an odd sketch
   of all of them (each sample flips one bit, so equal samples cancel in the XOR
   of two sketches and its population count estimates how many differ), and a
   128-bit fingerprint. Equal fingerprints are one class; the class's smallest
   doc_id stands for it from here on.
2. A bucket (band key) names a hub, the member that shares the most with
   others, and every member is compared with it: linear in the bucket, not
   quadratic. Full sets are built anew for texts in shared buckets. A set with too
   many shingles that no other of them has is linked with nothing and leaves
   the buckets. Pairs whose odd sketches are decisively apart go; the others are
   confirmed on the full sets.
3. Links become components. A bucket whose members lie in several components
   still has untested pairs: its members outside its largest component are
   compared with all the others, by size and sketch within the join, so that only
   likely links leave it. Where that would be far more than the buckets' own
   size, rounds with other hubs come first.

All pairs that share a band are so either tested, or already in one component
through tested links. A pair at exactly the threshold shares none of 24 bands of 4 with
probability 2e-8 at 85 / 100, and 3e-6 at 80 / 100.

Null or empty texts have n_shingles 0 and link with nothing. Rows without a
doc_id can't be named in a link: component null, kept true. Rows that repeat a
doc_id are one vertex, and each gets its row. Other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.words import LOWER, blocks, flat_list, grams, hash_spans, mix, run_sums, sequence_hash, signed, spans
from wayloom.operators.components import connected_components
from wayloom.plans.scratch import Scratch

SHINGLE, BANDS, ROWS, SAMPLES, BITS = 5, 24, 4, 128, 512
#: The threshold of op2_odd_sketches as a fraction, and how far under it an estimate may lie (in standard deviations).
LINK, SLACK = (85, 100), 5.0
_R = (mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)[:, None]
_A = (mix(np.arange(1001, SAMPLES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
_PLACE = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)


def text_sets(column, n: int = SHINGLE):
    """(row, sorted distinct shingle hashes) of every text of an Arrow column."""
    for i, j, a, off in blocks(column):
        a = LOWER[a]
        starts, ends, first = spans(a, off)
        h = hash_spans(run_sums(a), starts, ends)
        g = grams(h, n)
        for k in range(j - i):
            s, e = first[k], first[k + 1]
            if e - s >= n:
                yield i + k, np.unique(g[s : e - n + 1])
            elif e > s:
                yield i + k, np.array([sequence_hash(h[s:e])], np.uint64)
            else:
                yield i + k, np.zeros(0, np.uint64)


def samples(u: np.ndarray) -> np.ndarray:
    """MinHash samples of a nonempty set."""
    x = (u >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(least, ((x[None, k : k + 2048] ^ _R) * _A).min(axis=1), out=least)
    return least


def odd_sketch(least: np.ndarray) -> np.ndarray:
    bit = (mix(least.astype(np.uint64) | _PLACE) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(bit, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0xD1342543DE82EF95) + rows[:, k])
    return key


def sketch_limit(link: float = LINK[0] / LINK[1], slack: float = SLACK) -> int:
    """The most bits in which the sketches of linked sets differ, but for ``slack`` deviations."""
    least = link - slack * math.sqrt(link * (1 - link) / SAMPLES)
    return math.floor(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - least) / BITS)))


def _sketch_rows(batches):
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size, f1, f2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        bands, odd = np.zeros((n, BANDS), np.uint64), np.zeros((n, BITS // 64), np.uint64)
        for k, u in text_sets(batch.column("text")):
            size[k] = len(u)
            if len(u):
                least = samples(u)
                bands[k], odd[k] = band_keys(least), odd_sketch(least)
                f1[k], f2[k] = mix(u).sum(), mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size), pa.array(signed(f1)), pa.array(signed(f2)),
             flat_list(signed(bands.reshape(-1)), np.full(n, BANDS), pa.int64()), flat_list(signed(odd.reshape(-1)), np.full(n, BITS // 64), pa.int64())],
            names=["doc_id", "n", "f1", "f2", "bands", "odd"])


def _set_rows(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        rows, flat, count, total = [], [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), flat_list(signed(np.concatenate(flat)), np.array(count), pa.int64())], names=["id", "shingles"])

        for k, u in text_sets(batch.column("text")):
            rows.append(k)
            flat.append(u)
            count.append(len(u))
            total += len(u)
            if total > 1 << 20:
                yield out()
                rows, flat, count, total = [], [], [], 0
        if rows:
            yield out()


def _apart() -> F.Column:
    """In how many bits the odd sketches of two sides differ."""
    return sum((F.bit_count(F.col("ox")[k].bitwiseXOR(F.col("oy")[k])) for k in range(BITS // 64)), F.lit(0))


def _may_link(link: tuple[int, int]) -> F.Column:
    """Sizes, own shingles and sketches allow a link; columns nx, ux, ox and ny, uy, oy.

    What a set has alone it shares with none, so the intersection is at most the rest of the smaller rest.
    """
    common = F.least(F.col("nx") - F.col("ux"), F.col("ny") - F.col("uy"))
    return (link[1] * common >= link[0] * (F.col("nx") + F.col("ny") - common)) & (_apart() <= sketch_limit(link[0] / link[1]))


def _confirmed(near: DataFrame, sets: DataFrame, link: tuple[int, int]) -> DataFrame:
    """The pairs (x, y) whose full sets are linked."""
    sx = sets.select(F.col("id").alias("x"), F.col("shingles").alias("sx"))
    sy = sets.select(F.col("id").alias("y"), F.col("shingles").alias("sy"))
    both = near.join(sy, "y").join(sx, "x").withColumn("both", F.size(F.array_intersect("sx", "sy")))
    return both.where(link[1] * F.col("both") >= link[0] * (F.size("sx") + F.size("sy") - F.col("both"))).select("x", "y").distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None, max_hub_rounds: int = 6, effort: int = 50, link: tuple[int, int] = LINK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs`` (doc_id, text).

    ``effort``: rounds with other hubs come first while the pairs left to look at
    outnumber the buckets' members by more than this factor.
    ``link``: the least similarity of linked texts, as a fraction (whole numbers).
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = scratch.cut(docs.mapInArrow(_sketch_rows, "doc_id long, n long, f1 long, f2 long, bands array<long>, odd array<long>"), "sig")
    some = sig.where("n > 0 and doc_id is not null")
    classes = some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")).select(F.xxhash64("f1", "f2").alias("k"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), "rep")
    placed = sig.withColumn("k", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("f1", "f2")))
    placed = placed.join(classes, (placed["k"] == classes["k"]) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    first = F.col("rep") == F.col("doc_id")
    member = scratch.cut(placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"), F.when(first, F.col("bands")).alias("bands"), F.when(first, F.col("odd")).alias("odd")), "member")
    scratch.drop("sig")
    reps = member.where("bands is not null")
    member = member.select("doc_id", "n_shingles", "rep")
    rows = reps.select("rep", F.explode("bands").alias("b"))
    held = rows.groupBy("b").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    held = held.select(F.xxhash64("b").alias("k"), F.col("b").alias("hb"), "m")
    shared = scratch.cut(rows.withColumn("k", F.xxhash64("b")).join(held, "k").where("b = hb").select("b", "rep", "m"), "shared")
    n_shared = shared.count()

    def result(label: DataFrame | None) -> DataFrame:
        out = member.withColumn("component", F.col("rep")) if label is None else member.join(label.withColumnRenamed("id", "rep"), "rep", "left")
        component = F.coalesce("component", "rep")
        return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

    if not n_shared:
        return result(None)
    # what a text shares with how many others: a text in the middle of its copies has the most
    weight = shared.groupBy("rep").agg(F.sum("m").alias("w"))
    known = scratch.cut(reps.select("rep", F.col("n_shingles").alias("n"), "odd", "bands").join(weight, "rep"), "known")
    wanted = known.select(F.col("rep").alias("doc_id")).hint("shuffle_hash")
    sets = scratch.cut(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_set_rows, "id long, shingles array<long>"), "sets")
    alone = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("id2")).where("id = id2")
    alone = alone.groupBy(F.col("id").alias("rep")).agg(F.count(F.lit(1)).alias("u"))
    known = known.join(alone, "rep", "left").withColumn("u", F.least(F.coalesce("u", F.lit(0)), F.col("n")))
    # a set with too many shingles of its own can be linked with nothing
    known = scratch.cut(known.where(link[1] * (F.col("n") - F.col("u")) >= link[0] * F.col("n")), "linkable")
    shared = scratch.cut(shared.select("b", "rep").join(known, "rep"), "members")
    n_shared = shared.count()
    hubs = shared.groupBy("b").agg(F.max(F.struct("w", (-F.col("rep")).alias("r"))).alias("h")).select(F.xxhash64("b").alias("k"), F.col("b").alias("hb"), (-F.col("h.r")).alias("hub"))
    pairs = shared.select("b", "rep").withColumn("k", F.xxhash64("b")).join(hubs, "k").where("b = hb and rep <> hub").select(F.least("rep", "hub").alias("x"), F.greatest("rep", "hub").alias("y")).distinct()
    side = lambda i: known.select(F.col("rep").alias(i), F.col("n").alias(f"n{i}"), F.col("u").alias(f"u{i}"), F.col("odd").alias(f"o{i}"))
    near = pairs.join(side("x"), "x").join(side("y"), "y").where(_may_link(link)).select("x", "y")
    tested = near = scratch.cut(near, "near")
    edges = scratch.cut(_confirmed(near, sets, link), "links")
    label, before = None, None
    for k in range(max_hub_rounds + 1):
        label = scratch.cut(connected_components(spark, edges, "x", "y", scratch), f"label{k}")
        in_parts = shared.join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).select("b", "rep", "n", "u", "odd", "bands", "w", "c")
        part = in_parts.groupBy("b", "c").agg(F.count(F.lit(1)).alias("m"))
        bucket = part.groupBy("b").agg(F.count(F.lit(1)).alias("parts"), F.sum("m").alias("all"), F.max(F.struct("m", "c")).alias("big")).where("parts > 1")
        bucket = bucket.select(F.xxhash64("b").alias("k"), F.col("b").alias("ob"), F.col("big.c").alias("top"), ((F.col("all") - F.col("big.m")) * F.col("all")).alias("pairs"))
        rest = scratch.cut(in_parts.withColumn("k", F.xxhash64("b")).join(bucket, "k").where("b = ob").drop("k", "ob"), f"open{k}")
        left = rest.groupBy("b").agg(F.max("pairs").alias("pairs")).agg(F.sum("pairs").alias("pairs")).first().pairs or 0
        if not left:
            break
        # other hubs go on only while they help: members that are linked with nothing stay what they are
        last = k == max_hub_rounds or left <= effort * n_shared or (before is not None and 2 * left > before)
        before = left
        cols = [F.col("b").alias("b1"), F.col("rep").alias("r1"), F.col("c").alias("c1"), F.col("n").alias("nx"), F.col("u").alias("ux"), F.col("odd").alias("ox"), F.col("bands").alias("bx")]
        if last:
            one = rest.where("c <> top").select(*cols)
        else:  # the next hub of a bucket: of those outside its largest part the one with the most in common
            pick = rest.where("c <> top").groupBy("b").agg(F.max(F.struct("w", F.xxhash64("rep", F.lit(k)).alias("r"), "rep")).alias("h")).select(F.col("b").alias("pb"), F.col("h.rep").alias("pr"))
            one = rest.join(pick, (F.col("b") == F.col("pb")) & (F.col("rep") == F.col("pr"))).select(*cols)
        other = rest.select(F.xxhash64("b").alias("k"), "b", "rep", "c", F.col("n").alias("ny"), F.col("u").alias("uy"), F.col("odd").alias("oy"), F.col("bands").alias("by"))
        on = (F.col("k1") == F.col("k")) & (F.col("b1") == F.col("b")) & (F.col("c1") != F.col("c")) & _may_link(link)
        if last:  # a pair leaves the first bucket that it shares, not each
            on &= F.get(F.array_intersect("bx", "by"), F.lit(0)) == F.col("b1")
        more = one.withColumn("k1", F.xxhash64("b1")).join(other, on).select(F.least("r1", "rep").alias("x"), F.greatest("r1", "rep").alias("y")).distinct()
        more = scratch.cut(more.join(tested, ["x", "y"], "left_anti"), f"more{k}")
        if not more.isEmpty():
            tested = tested.union(more)
            new = scratch.cut(_confirmed(more, sets, link), f"links{k}")
            edges = edges.union(new)
            if last and not new.isEmpty():
                label = scratch.cut(connected_components(spark, edges, "x", "y", scratch), "label-last")
        if last:
            break
    return result(label)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept: one text of each component.

    Rows that repeat a doc_id stay once, with the least text (then the least of the other
    columns, as text); rows without one all stay.
    """
    kept = near_duplicates(docs, **options).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    named = docs.join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left_semi")
    order = F.struct(F.col("text"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))))
    one = named.groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), order).alias("_row"))
    named = one.select("_row.*")
    return named.unionByName(docs.where("doc_id is null"))
