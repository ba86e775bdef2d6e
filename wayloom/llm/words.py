"""Words and hashes of whole texts, vectorised over Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D, as the
pattern ``[^\\x20\\x09-\\x0D]+`` takes it. Word hashes are 64-bit: a polynomial
over a table of mixed byte codes, read off one running sum for a whole block
of texts, then mixed. Blocks bound the memory; a text longer than a block is a
block of its own, so nothing is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INNER = (np.arange(256) & 0xC0) == 0x80  # bytes inside a code point
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_CODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_POWERS = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, BLOCK + (BLOCK >> 2))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, U)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into bytes); null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and len(body) else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(at, at[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def spans(a: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and for each text the index of its first word (one more at the end)."""
    word = ~SPACE[a]
    after = np.ones(len(a), bool)
    after[1:] = ~word[:-1]
    after[off[:-1][off[:-1] < len(a)]] = True
    starts = np.flatnonzero(word & after)
    last = np.zeros(len(a), bool)
    if len(a):
        last[:-1] = ~word[1:]
        last[-1] = True
        ends_at = off[1:][off[1:] > 0] - 1
        last[ends_at] = True
    ends = np.flatnonzero(word & last) + 1
    return starts, ends, np.searchsorted(starts, off)


def run_sums(a: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a) + 1, U)
    np.cumsum(_CODE[a] * _powers(len(a) + 1)[0][: len(a)], out=total[1:])
    return total


def hash_spans(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    back = _powers(len(total))[1]
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U) * _STEP)


def word_sums(h: np.ndarray) -> np.ndarray:
    """Running sums over word hashes, from which ``span_hashes`` reads the hash of any span of words."""
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * _powers(len(h) + 1)[0][: len(h)], out=total[1:])
    return total


def span_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * _powers(len(total))[1][start] + (end - start).astype(U) * _STEP)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words (across texts too; see ``inside``)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    g = np.zeros(m, U)
    for k in range(n):
        g *= _STEP
        g += h[k : k + m]
    return mix(g)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Which windows of n words lie in one text; ``first`` as from ``spans``."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return of[: max(0, len(of) - n + 1)] == of[n - 1 :]


def sequence_hash(h: np.ndarray) -> int:
    """Hash of one whole word sequence."""
    g = U(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            g = g * _STEP + x
    return int(mix(np.array([g], U))[0])


def string_hash(words: list[bytes]) -> np.ndarray:
    """The same hashes for a list of words, used for small tables on the driver."""
    out = np.zeros(len(words), U)
    for k, w in enumerate(words):
        a = np.frombuffer(w, np.uint8)
        t = run_sums(a)
        out[k] = hash_spans(t, np.array([0]), np.array([len(a)]))[0]
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return x.view(np.int64)


def flat_list(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of the counts' lengths over one flat array."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
