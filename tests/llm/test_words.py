import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wayloom.llm.eliasfano import EliasFano, Trie, pack_sorted, quantise, restore, unpack_sorted
from wayloom.llm.words import blocks, grams, hash_spans, inside, run_sums, spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n \x0b\x85\u00a0ñ", max_size=30)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_hashes_are_those_of_the_pattern(texts, limit):
    seen, rows = {}, 0
    for i, j, a, off in blocks(pa.array(texts, pa.string()), limit):
        starts, ends, first = spans(a, off)
        h = hash_spans(run_sums(a), starts, ends)
        g, ok = grams(h, 3), inside(first, 3)
        expected = [WORD.findall(t or "") for t in texts[i:j]]
        assert np.diff(first).tolist() == [len(w) for w in expected]
        flat = [w for e in expected for w in e]
        assert [a[s:e].tobytes().decode() for s, e in zip(starts, ends)] == flat
        for w, x in zip(flat, h.tolist()):
            assert seen.setdefault(w, x) == x
        of = [k for k, e in enumerate(expected) for _ in e]
        assert ok.tolist() == [of[k] == of[k + 2] for k in range(max(0, len(of) - 2))]
        assert len(g) == len(ok)
        rows += j - i
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(5001, 1 << 40))
def test_elias_fano_round_trip_and_successor(values, universe):
    values = sorted(values)
    e = EliasFano(EliasFano.encode(np.array(values, np.uint64), universe))
    assert e[np.arange(len(values))].tolist() == values
    asked = np.array([0, 1, 17, 2500, 5000, *values[:50]], np.uint64)
    if values:
        assert e.successor(asked).tolist() == [int(np.searchsorted(values, int(x))) for x in asked]
    assert [i >= 0 for i in e.find(asked)] == [int(x) in values for x in asked]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 44) - 1), max_size=200), st.integers(1, 40))
def test_sorted_lists_round_trip(values, times):
    values = np.array(sorted(values * times), np.uint64)
    assert unpack_sorted(pack_sorted(values, 1 << 44)).tolist() == values.tolist()


def test_trie_finds_what_was_stored():
    r = random.Random(1)
    pairs = sorted({(r.randrange(200) << 32) | r.randrange(300) for _ in range(4000)})
    count = np.array([r.randrange(1, 500) for _ in pairs])
    t = Trie(Trie.build(np.array(pairs, np.uint64), count))
    asked = np.array([(r.randrange(220) << 32) | r.randrange(320) for _ in range(3000)], np.uint64)
    have = dict(zip(pairs, count.tolist()))
    got = restore(t.lookup(asked))
    for x, y in zip(asked.tolist(), got.tolist()):
        c = have.get(x, 0)
        assert (y == c) if c <= 128 else abs(y / c - 1) < 0.11
    assert Trie(Trie.build(np.zeros(0, np.uint64), np.zeros(0, np.int64))).lookup(asked).sum() == 0


def test_quantised_counts_are_exact_to_128_and_monotone():
    c = np.arange(0, 100_000)
    q = restore(quantise(c))
    assert (q[:129] == c[:129]).all() and (np.diff(q) >= 0).all()


def test_packed_indices_round_trip():
    from wayloom.llm.ngramlm import _pack_index, _unpack_index

    for top in (0, 1, 65_535, 65_536, 1 << 24):
        x = np.array([0, top, top // 2, 1 if top else 0])
        assert _unpack_index(_pack_index(x)).tolist() == x.tolist()
    assert len(_unpack_index(_pack_index(np.zeros(0, np.int64)))) == 0


def test_positions_by_shard():
    from wayloom.llm.ngramlm import by_shard

    r = np.random.default_rng(2)
    for shards in (1, 7, 300, 1 << 17):
        shard = r.integers(0, shards, 2000)
        got = list(by_shard(shard))
        assert [s for s, _ in got] == sorted(set(shard.tolist())) and all((own == np.flatnonzero(shard == s)).all() for s, own in got)
    assert list(by_shard(np.zeros(0, np.int64))) == []
