"""N-gram language-model scores from Elias-Fano tries (operator 6).

Tokens are the words, A-Z lower-cased, then one end. The model is learnt from
the rows whose crc32(doc_id as text) mod 5 isn't 1 and scores all rows:

    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | v) = (c(v, w) + k p(w)) / (c(v) + k)
    p(w | u, v) = (c(u, v, w) + k p(w | v)) / (c(u, v) + k)

with v the word before (or the start) and u the one before that; a text's first
token is scored by its pair. Word counts are exact; counts of pairs and triples
are held as 8-bit codes (exact to 128) in the tries, and c(u, v) is the pair's.

The model grows with the corpus, so it is never sent to one machine. Its
tries are shards by context: each block of texts sends every shard the distinct
words, pairs and triples it has for it, with their training counts; a shard adds
them up, builds a trie of each length, maps it, answers from it, and each
block is scored from its answers. A context is spread over several
shards, and a block names a word, pair or triple once however often it has it, so a
hot one adds one entry a block.

Within a shard a pair or triple is a key of KEY bits, the last LOW of them mixed from context and
word. A shard's size is bounded by ``shard_chars`` whatever the corpus is, so one of a fixed width
does: with 2 million keys in a shard an unseen one is taken for a seen one with probability 2e-7.

Texts are read whole. A null or empty text has one token, the end. A row
without a doc_id counts as training. Repeated rows are learnt and scored each. Other
columns aren't read. Empty input gives an empty result. The input is scanned twice
and must be the same table both times (files, or a written table).
"""

from __future__ import annotations

import hashlib
import mmap
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.eliasfano import Trie, pack_sorted, restore, unpack_sorted
from wayloom.llm.words import LOWER, blocks, hash_spans, mix, run_sums, spans
from wayloom.plans.scratch import Scratch

U = np.uint64
#: Text in a block, and text for which there is one more shard: both bound what a task holds.
BLOCK_BYTES = 4 << 20
SHARD_CHARS = 8_000_000
PRIOR = 5.0
KEY, LOW = 44, 26
_PAIR, _TRIPLE = 2, 5  # kinds of rows that ask a trie
_END, _START = (int(x) for x in mix(np.array([11, 12], U)))
_ASK = "kind int, block long, shard int, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["kind", "block", "shard", "a", "b", "c", "d", "e"]


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _shut(raw: bytes) -> bytes:
    """Entropy-coded, which the shuffle's own compression isn't."""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _open(shut: bytes) -> bytes:
    n = int.from_bytes(shut[:8], "little")
    return pa.decompress(shut[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""


def _pack_counts(c: np.ndarray) -> tuple[bytes, bytes]:
    """One byte each; 255 points to the next of the long ones."""
    return _shut(np.minimum(c, 255).astype(np.uint8).tobytes()), c[c >= 255].astype(np.int64).tobytes()


def _unpack_counts(small: bytes, large: bytes) -> np.ndarray:
    c = np.frombuffer(_open(small), np.uint8).astype(np.int64)
    c[c == 255] = np.frombuffer(large, np.int64)
    return c


def _pack_index(x: np.ndarray) -> bytes:
    """The low bytes of all, then the next bytes of all, as many as the largest needs, each entropy-coded."""
    planes = [_shut((x >> s & 255).astype(np.uint8).tobytes()) for s in range(0, max(1, int(x.max(initial=0)).bit_length()), 8)]
    return bytes([len(planes)]) + b"".join(len(p).to_bytes(8, "little") + p for p in planes)


def _unpack_index(packed: bytes) -> np.ndarray:
    at, x = 1, np.zeros(0, np.int64)
    for k in range(packed[0]):
        n = int.from_bytes(packed[at : at + 8], "little")
        plane = np.frombuffer(_open(packed[at + 8 : at + 8 + n]), np.uint8).astype(np.int64)
        x = plane if not k else x | plane << (8 * k)
        at += 8 + n
    return x


class _Block:
    """The tokens of some texts as indices into their distinct words."""

    def __init__(self, ids: list, a: np.ndarray, off: np.ndarray):
        seal = hashlib.blake2b(repr(ids).encode() + off.tobytes(), digest_size=8)
        seal.update(np.ascontiguousarray(a))
        a = LOWER[a]
        starts, ends, first = spans(a, off)
        h = hash_spans(run_sums(a), starts, ends)
        n = np.diff(first)
        self.n_tokens = n + 1
        tokens = np.full(int(self.n_tokens.sum()), _END, U)
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(self.n_tokens) - 1] = False
        tokens[inner] = h
        self.words, self.index, often = np.unique(np.append(tokens, U(_START)), return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # frequent words get small numbers, which take less room
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words, self.index = self.words[order], place[self.index]
        self.start, self.index = self.index[-1], self.index[:-1]
        self.ids, self.held_out = ids, np.array([is_held_out(x) for x in ids], bool)
        self.key = int.from_bytes(seal.digest(), "little", signed=True)  # by content: the same in every scan

    def asks(self, shards: int, spread: int):
        v = len(self.words)
        train = np.repeat(~self.held_out, self.n_tokens)
        count = np.bincount(self.index[train], minlength=v)
        count_start = int((~self.held_out).sum())
        for s, own in by_shard(word_shard(self.words, shards)):
            own = own[self.words[own] != U(_START)]
            if len(own):
                small, large = _pack_counts(count[own])
                yield 1, self.key, s, self.words[own].tobytes(), small, large, None, None
        for kind, n, of, used, ctx, suc in self.grams():
            learnt = np.bincount(of[train[used]], minlength=n)
            for s, key, own in by_key(ctx, suc, shards, spread):
                small, large = _pack_counts(learnt[own])
                yield kind, self.key, s, pack_sorted(key, 1 << KEY), small, large, None, None
        yield 3, self.key, -1 - self.key % 16, b"%d" % count_start, None, None, None, None

    def grams(self):
        """For pairs, then triples: kind, how many are distinct, each token's among them, which tokens have one, hashes of contexts and words."""
        v = len(self.words)
        at = np.cumsum(self.n_tokens) - self.n_tokens
        before = np.empty(len(self.index), np.int64)
        before[1:] = self.index[:-1]
        before[at] = self.start
        self.pair, self.pair_of = np.unique(before * v + self.index, return_inverse=True)
        yield _PAIR, len(self.pair), self.pair_of, slice(None), self.words[self.pair // v], self.words[self.pair % v]
        self.inner = np.ones(len(self.index), bool)
        self.inner[at] = False
        inner = np.flatnonzero(self.inner)
        self.triple, self.triple_of = np.unique(self.pair_of[inner - 1] * v + self.index[inner], return_inverse=True)
        ctx = self.pair[self.triple // v]
        yield _TRIPLE, len(self.triple), self.triple_of, inner, mix(mix(self.words[ctx // v]) + self.words[ctx % v]), self.words[self.triple % v]

    def header(self):
        return (0, self.key, -1, self.words.tobytes(), _pack_index(self.index), self.n_tokens.astype(np.int64).tobytes(),
                np.array([-1 if x is None else x for x in self.ids], np.int64).tobytes(), np.append(self.held_out, [x is None for x in self.ids]).astype(np.uint8).tobytes())


def word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (h % U(shards)).astype(np.int64)


def by_key(ctx: np.ndarray, suc: np.ndarray, shards: int, spread: int):
    """(shard, its keys in order, their positions) of pairs of hashes."""
    c = mix(ctx)
    key = c >> U(64 - KEY + LOW) << U(LOW) | mix(c + suc) >> U(64 - LOW)
    shard = ((c % U(shards) + mix(suc + U(1)) % U(spread)) % U(shards)).astype(np.int64)
    order = np.argsort(key)
    for s, own in by_shard(shard[order]):
        own = order[own]
        yield s, key[own], own


def by_shard(shard: np.ndarray):
    """(shard, positions in order) for each shard that has any: one sort, however many shards there are."""
    if not len(shard):
        return
    order = np.argsort(shard.astype(np.uint16) if shard.max() < 1 << 16 else shard, kind="stable")  # short keys sort in linear time
    own = shard[order]
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    for s, e in zip(head, np.append(head[1:], len(own)), strict=True):
        yield int(own[s]), order[s:e]


def _blocks(batches):
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for i, j, a, off in blocks(batch.column("text"), BLOCK_BYTES):
            yield _Block(ids[i:j], a, off)


def _table(rows: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def _shard(table: pa.Table) -> pa.Table:
    """Add up a shard's requests, build and map its trie, answer the requests."""
    kind, block = table.column("kind").to_numpy(), table.column("block").to_numpy()
    shard = table.column("shard")[0].as_py()
    cells = lambda name, rows: [x.as_py() for x in table.column(name).take(pa.array(rows))]
    out = []
    rows = np.flatnonzero(kind == 1)
    if len(rows):
        keys = [np.frombuffer(x, U) for x in cells("a", rows)]
        counts = [_unpack_counts(x, y) for x, y in zip(cells("b", rows), cells("c", rows), strict=True)]
        total, of = _added(np.concatenate(keys), np.concatenate(counts))[1:]
        at = 0
        for r, k in zip(rows, keys, strict=True):
            out.append((1, int(block[r]), shard, *_pack_counts(total[of[at : at + len(k)]]), None, None, None))
            at += len(k)
        out.append((4, 0, shard, b"%d" % total.sum(), b"%d" % (total > 0).sum(), None, None, None))
        del keys, counts, of, total
    for level in (_PAIR, _TRIPLE):
        rows = np.flatnonzero(kind == level)
        if not len(rows):
            continue
        keys = [unpack_sorted(x) for x in cells("a", rows)]
        sizes = [len(x) for x in keys]
        keys = np.concatenate(keys)
        counts = np.concatenate([_unpack_counts(x, y) for x, y in zip(cells("b", rows), cells("c", rows), strict=True)])
        keys, counts, of = _added(keys, counts)
        packed = Trie.build(keys[counts > 0], counts[counts > 0], LOW, KEY)
        held = mmap.mmap(-1, len(packed))
        held.write(packed)
        del packed, counts
        code = Trie(held).lookup(keys)
        at = 0
        for r, n in zip(rows, sizes, strict=True):
            out.append((level, int(block[r]), shard, _shut(code[of[at : at + n]].tobytes()), None, None, None, None))
            at += n
        del keys, of, code
    return pa.Table.from_batches([_table(out)])


def _added(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their counts added up, and each key's place among them. Keys come as sorted runs, which a stable sort merges."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.append(True, key[1:] != key[:-1])[: len(key)]
    head = np.flatnonzero(first)
    of = np.empty(len(key), np.int32)
    of[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return key[head], np.add.reduceat(count[order], head) if len(head) else count, of


_SCORES = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def _scorer(shards: int, spread: int, total: int, distinct: int, starts: int, prior: float):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        heads = [r for r in rows if r["kind"] == 0]
        if not heads:
            raise RuntimeError("a block's texts changed between two scans: the input must be a stable table")
        return pa.concat_tables([score(head, rows) for head in heads])  # blocks of equal rows share a key and their answers

    def score(head: dict, rows: list[dict]) -> pa.Table:
        words, index = np.frombuffer(head["a"], U), _unpack_index(head["b"])
        n_tokens, ids = np.frombuffer(head["c"], np.int64), np.frombuffer(head["d"], np.int64)
        flags = np.frombuffer(head["e"], np.uint8).astype(bool).reshape(2, -1)
        b = _Block.__new__(_Block)
        b.words, b.index, b.n_tokens = words, index, n_tokens
        b.start = int(np.flatnonzero(words == U(_START))[0])
        v = len(words)
        count = np.zeros(v, np.int64)
        real = np.flatnonzero(words != U(_START))
        own = dict(by_shard(word_shard(words[real], shards)))
        for r in rows:
            if r["kind"] == 1:
                count[real[own[r["shard"]]]] = _unpack_counts(r["a"], r["b"])
        codes = {}
        for kind, n, _, _, ctx, suc in b.grams():
            codes[kind] = np.zeros(n, np.uint8)
            own = {s: at for s, _, at in by_key(ctx, suc, shards, spread)}
            for r in rows:
                if r["kind"] == kind:
                    codes[kind][own[r["shard"]]] = np.frombuffer(_open(r["a"]), np.uint8)
        p1 = (count + 0.5) / (total + 0.5 * (distinct + 1))
        context = count.astype(float)
        context[b.start] = starts
        ctx, suc = b.pair // v, b.pair % v
        c2 = restore(codes[_PAIR])
        p2 = (np.minimum(c2, context[ctx]) + prior * p1[suc]) / (context[ctx] + prior)
        p = p2[b.pair_of]
        c2 = c2[b.triple // v]
        p[b.inner] = ((np.minimum(restore(codes[_TRIPLE]), c2) / (c2 + prior))[b.triple_of]
                      + (prior / (c2 + prior))[b.triple_of] * p[b.inner])
        at = np.cumsum(n_tokens) - n_tokens
        sums = lambda x: np.add.reduceat(x, at) if len(at) else np.zeros(0)
        cols = [pa.array(ids, pa.int64(), mask=flags[1]), flags[0], n_tokens, sums((count > 0)[index].astype(np.int64)), sums(np.log10(p1)[index]), sums(np.log10(p))]
        return pa.table({n: pa.array(c, k) if not isinstance(c, pa.Array) else c for c, (n, k) in zip(cols, _SCORES, strict=True)})

    return run


def ngram_scores(docs: DataFrame, prior: float = PRIOR, shard_chars: int = SHARD_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession, "ngrams")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = max(4, -(-chars // shard_chars))
    spread = max(2, shards // 8)

    def ask(batches):
        for b in _blocks(batches):
            yield from (_table([r]) for r in b.asks(shards, spread))

    def heads(batches):
        for b in _blocks(batches):
            yield _table([b.header()])

    asked = docs.mapInArrow(ask, _ASK)
    # as many tasks as shards or blocks, so that none reads more as the corpus grows
    answers = scratch.cut(asked.repartition(shards, "shard").groupBy("shard").applyInArrow(_answer, _ASK), "answers")
    number = lambda c, k: F.sum(F.when(F.col("kind") == k, F.col(c).cast("string").cast("long")))
    n = answers.where("kind in (3, 4)").agg(number("a", 4).alias("total"), number("b", 4).alias("distinct"), number("a", 3).alias("starts")).first()
    total, distinct, starts = n.total or 0, n.distinct or 0, n.starts or 0
    together = answers.where("kind in (1, 2, 5)").unionByName(docs.mapInArrow(heads, _ASK))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = together.repartition(max(4, -(-chars // BLOCK_BYTES)), "block").groupBy("block").applyInArrow(_scorer(shards, spread, total, distinct, starts, prior), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _answer(table: pa.Table) -> pa.Table:
    """A shard's answers; the numbers of texts (shards below 0) are added up."""
    if table.column("shard")[0].as_py() >= 0:
        return _shard(table)
    n = sum(int(x) for x in table.column("a").to_pylist())
    return pa.Table.from_batches([_table([(3, 0, -1, b"%d" % n, None, None, None, None)])])
