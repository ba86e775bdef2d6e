"""Elias-Fano lists and the n-gram trie over them (see ``ngramlm``).

A monotone list of n values below u is stored as the low bits of each value,
packed, and the high bits as a bit vector of n ones and u >> l zeros, with a
running count per 64-bit word: about 2 + log2(u / n) bits a value. All arrays
are views into one buffer, so a written trie is opened by mapping its file.
"""

from __future__ import annotations

import struct

import numpy as np

U = np.uint64
_ONE = U(1)


def _select_in_word(w: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th set bit (from 0) of each word, by halving."""
    w, r, pos = w.copy(), r.copy(), np.zeros(len(w), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(w & U((1 << width) - 1)).astype(np.int64)
        go = r >= low
        r -= np.where(go, low, 0)
        pos += np.where(go, width, 0)
        w = np.where(go, w >> U(width), w)
    return pos


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits, little-endian, in 64-bit words (one more word at the end)."""
    n = len(values)
    out = np.zeros(n * width // 64 + 2, U)
    if not width or not n:
        return out
    bit = np.arange(n, dtype=np.int64) * width
    word, shift = bit >> 6, (bit & 63).astype(U)
    for part, at in ((values << shift, word), (np.where(shift > 0, values >> ((U(64) - shift) & U(63)), U(0)), word + 1)):
        head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[head]] |= np.bitwise_or.reduceat(part, head)
    return out


class EliasFano:
    HEAD = struct.Struct("<QQQQQ")  # n, universe, low width, words of low, words of high

    def __init__(self, buffer, at: int = 0):
        self.n, self.universe, self.width, nl, nh = self.HEAD.unpack_from(buffer, at)
        at += self.HEAD.size
        self.low = np.frombuffer(buffer, U, nl, at)
        self.high = np.frombuffer(buffer, U, nh, at + 8 * nl)
        self.ones = np.frombuffer(buffer, np.int64, nh + 1, at + 8 * (nl + nh))
        self.end = at + 8 * (nl + nh + nh + 1)

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> bytes:
        values = np.asarray(values, U)
        n = len(values)
        width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        low = _pack(values & U((1 << width) - 1), width)
        place = (values >> U(width)).astype(np.int64) + np.arange(n)
        bits = n + (universe >> width) + 1
        high = np.zeros(bits // 64 + 1, U)
        if n:
            word = place >> 6
            head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            high[word[head]] = np.bitwise_or.reduceat(_ONE << (place & 63).astype(U), head)
        ones = np.zeros(len(high) + 1, np.int64)
        np.cumsum(np.bitwise_count(high), out=ones[1:])
        return cls.HEAD.pack(n, universe, width, len(low), len(high)) + low.tobytes() + high.tobytes() + ones.tobytes()

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(U)
        x = self.low[word] >> shift
        over = shift > 0
        x |= np.where(over, self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return x & U((1 << self.width) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((place - i).astype(U) << U(self.width)) | self._low(i)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """How many values have high part below h."""
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        k = np.maximum(h - 1, 0)
        word = np.searchsorted(zeros, k, "right") - 1
        place = word * 64 + _select_in_word(~self.high[word], k - zeros[word])
        return np.where(h > 0, place - k, 0)

    def successor(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | None = None) -> np.ndarray:
        """Least position in [lo, hi) whose value is at least x, else hi: the bucket of x's high bits, then halving."""
        x = np.asarray(x, U)
        h = (x >> U(self.width)).astype(np.int64)
        hi = np.full(len(x), self.n, np.int64) if hi is None else hi
        a = np.maximum(self._bucket(h), lo)
        b = np.minimum(self._bucket(h + 1), hi)
        a = np.minimum(a, hi)
        b = np.maximum(a, b)
        low = x & U((1 << self.width) - 1)
        while True:
            todo = np.flatnonzero(a < b)
            if not len(todo):
                return a
            mid = (a[todo] + b[todo]) >> 1
            less = self._low(mid) < low[todo]
            a[todo] = np.where(less, mid + 1, a[todo])
            b[todo] = np.where(less, b[todo], mid)

    def find(self, x: np.ndarray, lo=0, hi=None) -> np.ndarray:
        """Position of x in [lo, hi), or -1."""
        x = np.asarray(x, U)
        if not self.n:
            return np.full(len(x), -1, np.int64)
        i = self.successor(x, lo, hi)
        ok = i < (self.n if hi is None else hi)
        got = self[np.minimum(i, self.n - 1)]
        return np.where(ok & (got == x), i, -1)


#: Codes of a count or of a probability in units of 1 / total: exact up to 128, then steps of a tenth.
_STEPS = np.unique(np.concatenate([np.arange(0, 129), np.floor(128 * 1.21 ** np.arange(1, 127))]).astype(np.int64))[:256]


def quantise(count: np.ndarray) -> np.ndarray:
    """8-bit code of the nearest step, by ratio."""
    up = np.minimum(np.searchsorted(_STEPS, count), len(_STEPS) - 1)
    down = np.maximum(up - 1, 0)
    nearer = (_STEPS[up] == count) | (count * count >= _STEPS[up].astype(float) * np.maximum(_STEPS[down], 1))
    return np.where(nearer, up, down).astype(np.uint8)


def restore(code: np.ndarray) -> np.ndarray:
    return _STEPS[code].astype(float)


def pack_sorted(values: np.ndarray, universe: int) -> bytes:
    """A monotone list to send: Elias-Fano parts without the running counts that only a search needs."""
    values = np.asarray(values, U)
    n = len(values)
    width = max(0, (universe // max(n, 1)).bit_length() - 1)
    place = (values >> U(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(place[-1]) + 1 if n else 0, np.uint8)
    high[place] = 1
    low = _pack(values & U((1 << width) - 1), width).view(np.uint8)[: -(-n * width // 8)]
    return struct.pack("<QB", n, width) + low.tobytes() + np.packbits(high, bitorder="little").tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", packed)
    size = -(-n * width // 8)
    low = np.zeros(n * width // 64 + 2, U)
    low.view(np.uint8)[:size] = np.frombuffer(packed, np.uint8, size, 9)
    place = np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, -1, 9 + size), bitorder="little"))[:n]
    e = EliasFano.__new__(EliasFano)
    e.width, e.low = width, low
    i = np.arange(n, dtype=np.int64)
    return ((place - i).astype(U) << U(width)) | e._low(i)


class Trie:
    """The contexts of one length and the successors of each.

    A key is a context's hash followed by ``low`` bits for a word after it. Contexts are a
    sorted list; a monotone pointer per context bounds its successors, which are stored
    relative to it (the context's rank, then the low bits: one monotone list) and looked
    for by a successor search within the pointers.
    """

    HEAD = struct.Struct("<QQQ")

    def __init__(self, buffer):
        self.m, self.n, low = self.HEAD.unpack_from(buffer, 0)
        self.low = U(low)
        self.context = EliasFano(buffer, self.HEAD.size)
        self.pointer = EliasFano(buffer, self.context.end)
        self.successor = EliasFano(buffer, self.pointer.end)
        self.code = np.frombuffer(buffer, np.uint8, self.n, self.successor.end)

    @classmethod
    def build(cls, keys: np.ndarray, count: np.ndarray, low: int = 32, bits: int = 64) -> bytes:
        """From sorted distinct keys of ``bits`` bits and their counts."""
        ctx, suc = keys >> U(low), keys & U((1 << low) - 1)
        head = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(keys) else np.zeros(0, np.int64)
        rank = np.repeat(np.arange(len(head), dtype=U), np.diff(np.append(head, len(keys))))
        parts = [EliasFano.encode(ctx[head], 1 << (bits - low)), EliasFano.encode(np.append(head, len(keys)), len(keys) + 1),
                 EliasFano.encode(rank << U(low) | suc, max(1, len(head)) << low)]
        return cls.HEAD.pack(len(head), len(keys), low) + b"".join(parts) + quantise(count).tobytes()

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Code of each key; 0 where it wasn't seen. Runs of one context look for it once."""
        out = np.zeros(len(keys), np.uint8)
        if not len(keys) or not self.n:
            return out
        ctx = keys >> self.low
        head = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
        of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(keys))))
        c = self.context.find(ctx[head])
        known = np.maximum(c, 0)
        lo, hi = self.pointer[known].astype(np.int64), self.pointer[known + 1].astype(np.int64)
        ok = np.flatnonzero(c[of] >= 0)
        of = of[ok]
        x = c[of].astype(U) << self.low | keys[ok] & U((1 << int(self.low)) - 1)
        at = self.successor.find(x, lo[of], hi[of])
        out[ok[at >= 0]] = self.code[at[at >= 0]]
        return out
