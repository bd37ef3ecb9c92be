"""Quality rules on repetition: how much of a text lies in repeated n-grams and lines.

Each slice of rows is hashed in a few numpy passes: words and lines by prefix
sums of a rolling hash, n-grams by combining the hashes of their words. What
repeats within a text is found by sorting those hashes together with the row.

Defined results: a null or empty text has no words and all counts 0, and fails
the base rule (fewer than 50 words); rows that repeat are judged alike; an empty
table gives an empty result; only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

#: Most of a text's word characters that duplicated n-grams of each length may cover.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most of a text's word characters that lines equal to an earlier one may hold.
LINE_LIMIT = 0.20
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    if not len(keys):
        return np.zeros(0, bool)
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _salted(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a row."""
    return T.mix(hashes + (rows.astype(T.U64) + T.U64(1)) * T.U64(0x9E3779B97F4A7C15))


def _covered(windows: np.ndarray, hit: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside the windows that are hit."""
    edge = np.zeros(words + 1, np.int64)
    at = windows[hit]
    edge[: words + 1] += np.bincount(at, minlength=words + 1)
    edge -= np.bincount(at + n, minlength=words + 1)[: words + 1]
    return np.cumsum(edge)[:words] > 0


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> dict[str, np.ndarray]:
    """Counts of each row of a slice."""
    chars = np.concatenate([[0], np.cumsum(_HEAD[data], dtype=np.int64)])
    span = T.SpanHash(data)
    begin, end, first = T.words(data, offsets)
    rows = T.row_of(first)
    word_chars = chars[end] - chars[begin]
    hashes = span(begin, end)
    out = {"n_words": np.diff(first), "word_chars": T.sums(word_chars, first), "n_symbols": T.sums(_SYMBOL[data], offsets)}
    lb, le, lf = T.lines(data, offsets)
    worded = np.searchsorted(begin, le) > np.searchsorted(begin, lb)
    lb, le, rl = lb[worded], le[worded], T.row_of(lf)[worded]
    key = _salted(span(lb, le), rl)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = np.bincount(rl[again], minlength=len(first) - 1)
    held = np.concatenate([[0], np.cumsum(word_chars)])
    line_chars = held[np.searchsorted(begin, le)] - held[np.searchsorted(begin, lb)]
    out["dup_line_chars"] = np.bincount(rl[again], weights=line_chars[again], minlength=len(first) - 1).astype(np.int64)
    for n in (3, *lengths):
        w, at = T.windows(hashes, first, n)
        inside = _covered(at, repeated(_salted(w, rows[at])), n, len(begin))
        if n == 3:
            out["n_repeat_words"] = T.sums(inside, first)
        if n in lengths:
            out[f"dup_{n}gram_chars"] = T.sums(inside * word_chars, first)
    return out


def repetition(docs: DataFrame, text: str = "text", key: str = "doc_id", limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Counts and verdicts of every row: base_failed by the base rule, kept by it and the coverage limits."""
    limits = limits or NGRAM_LIMITS
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in limits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.slices(batch.column(1)):
                got = measure(data, offsets, tuple(limits))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(got[c], pa.int64()) for c in names)], [key, *names])

    kind = dict(docs.select(key).dtypes)[key]
    found = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in names))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = F.col("dup_line_chars") > line_limit * F.col("word_chars")
    for n, most in limits.items():
        over = over | (F.col(f"dup_{n}gram_chars") > most * F.col("word_chars"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)
