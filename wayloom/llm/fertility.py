"""Quality rules from tokeniser fertility (operator 3).

A public vocabulary says how text differs from the text it was made for:
characters per token fall, byte-fallback tokens (parts of a code point) rise,
and the entropy of the tokens leaves its usual band when text is junk, a
table of symbols or a loop. Each language, or each script where the language
is unknown, has its own band of each measure.

Texts are read whole. Nulls count as empty. An empty text has no words, so the
base rules reject it; its measures are 0. Repeated rows are judged alike, one
by one; other columns are not read.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.words import INNER, SPACE, blocks, grams, hash_spans, inside, mix, run_sums, spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Band:
    """Kept: characters per token within [least, most], byte-fallback share at
    most ``fallback``, and token entropy over its possible maximum (log2 of the
    number of tokens, 10 bits at most) at least ``evenness``."""

    least: float
    most: float
    fallback: float
    evenness: float


#: By language code, else by the script of most letters. Clean prose of the four
#: languages has an evenness of 0.64 and more; symbols and shouting have less.
BANDS = {
    "en": Band(1.9, 7.0, 0.06, 0.64),
    "de": Band(1.6, 7.0, 0.14, 0.63),
    "fr": Band(1.5, 7.0, 0.24, 0.61),
    "es": Band(1.5, 7.0, 0.26, 0.61),
    "latin": Band(1.4, 8.0, 0.30, 0.50),
    "other": Band(0.25, 8.0, 0.90, 0.30),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_GRAM = 5
FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
          ("n_repeat_words", pa.int64()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()),
          ("byte_share", pa.float64()), ("entropy", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]


def _per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _later_copies(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: equal to another, and equal to an earlier one."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def base_counts(a: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of a block of texts that need no vocabulary."""
    n = len(off) - 1
    starts, ends, first = spans(a, off)
    total = run_sums(a)
    h = hash_spans(total, starts, ends)
    out = {"n_words": np.diff(first), "word_chars": _per_text(~SPACE[a] & ~INNER[a], off), "n_symbols": _per_text(_SYMBOL[a], off)}
    of = np.repeat(np.arange(n), np.diff(first))
    g = grams(h, _GRAM)
    at = np.flatnonzero(inside(first, _GRAM))
    twice, _ = _later_copies(mix(g[at] ^ (of[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))))
    cover = np.zeros(len(h) + 1, np.int64)
    hit = at[twice]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + _GRAM, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(cover)[:-1] > 0, first)
    breaks = np.flatnonzero(a == 10)
    line_at = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], breaks + 1]))
    line_at = line_at[line_at < len(a)]
    if len(line_at):
        stop = np.append(line_at[1:], len(a))
        stop = stop - (a[stop - 1] == 10)
        worded = np.searchsorted(starts, stop) > np.searchsorted(starts, line_at)
        line_at, stop = line_at[worded], stop[worded]
        home = np.searchsorted(off, line_at, "right") - 1
        key = mix(hash_spans(total, line_at, stop) ^ (home.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        _, later = _later_copies(key)
        out["n_dup_lines"] = np.bincount(home[later], minlength=n)
    else:
        out["n_dup_lines"] = np.zeros(n, np.int64)
    return out


def _script(text: str) -> str:
    latin = sum(c < "ɐ" for c in text if c.isalpha())
    letters = sum(c.isalpha() for c in text)
    return "latin" if 2 * latin >= letters else "other"


class Rules:
    """The rules with a vocabulary, as sent to executors (the packed vocabulary is under 1 MB, the same at every size)."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN, bands: dict[str, Band] | None = None, min_words: int = 10, max_repeat: float = 0.2):
        with open(vocabulary, "rb") as f:
            self.packed = f.read()
        self.pattern, self.bands, self.min_words, self.max_repeat = pattern, BANDS if bands is None else bands, min_words, max_repeat
        self.coder = None

    def load(self) -> None:
        import tiktoken

        ranks = {base64.b64decode(k): int(v) for k, v in (x.split() for x in self.packed.splitlines() if x)}
        self.coder = tiktoken.Encoding("fertility", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        self.partial = np.zeros(max(ranks.values()) + 1, bool)
        for piece, rank in ranks.items():
            try:
                piece.decode()
            except UnicodeDecodeError:
                self.partial[rank] = True

    def judge(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """An array for each of FIELDS."""
        if self.coder is None:
            self.load()
        lang = batch.column("lang").to_pylist()
        parts: list[list[np.ndarray]] = [[np.zeros(0)] for _ in FIELDS]
        for i, j, a, off in blocks(batch.column("text")):
            c = base_counts(a, off)
            n_tokens, cpt, share, entropy, good = (np.zeros(j - i) for _ in range(5))
            for k in range(j - i):
                text = a[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace")
                if not text:
                    continue
                ids = self.coder.encode_to_numpy(text)
                p = np.unique(ids, return_counts=True)[1] / len(ids)
                n_tokens[k], cpt[k], share[k] = len(ids), len(text) / len(ids), self.partial[ids].mean()
                entropy[k] = -(p * np.log2(p)).sum()
                band = self.bands.get(lang[i + k]) or self.bands[_script(text)]
                even = entropy[k] / min(10.0, np.log2(len(ids))) if len(ids) > 1 else 0.0
                good[k] = band.least <= cpt[k] <= band.most and share[k] <= band.fallback and even >= band.evenness
            failed = (c["n_words"] < self.min_words) | (c["n_repeat_words"] > self.max_repeat * c["n_words"])
            own = [c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"], n_tokens, cpt, share, entropy, failed, ~failed & (good > 0)]
            for x, y in zip(parts, own, strict=True):
                x.append(y)
        return [np.concatenate(x).astype(kind.to_pandas_dtype()) for x, (_, kind) in zip(parts, FIELDS, strict=True)]


def fertility_rules(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """doc_id, the counts, the measures, base_failed and kept: a row for each row of ``docs`` (doc_id, text, lang)."""
    rules = rules or Rules()

    def run(batches):
        for batch in batches:
            cols = [pa.array(x, kind) for x, (_, kind) in zip(rules.judge(batch), FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *(n for n, _ in FIELDS)])

    kinds = {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean"}
    schema = "doc_id long, " + ", ".join(f"{n} {kinds[k]}" for n, k in FIELDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, schema)


def passing(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns (text and lang are strings)."""
    rules = rules or Rules()

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(rules.judge(batch)[-1]))

    return docs.mapInArrow(run, docs.schema)
