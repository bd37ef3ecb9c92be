"""Secret scans: fixed patterns, and formats learned from labelled credentials.

One pass over the texts finds the fixed patterns' spans and the candidates (long
runs of credential characters that mix letters and digits). The labelled
credentials are a bounded sample of what the patterns found (the first
``max_labelled`` by hash) and examples of public formats drawn from their rules.
From each kind's examples a prefix tree is built and its statistically compatible
states are merged into a probabilistic automaton; every candidate is then scored
by its likelihood per symbol against ordinary text.

Defined results: a null or empty text has no spans; rows that repeat are scanned
alike; equal starts are ordered by kind; an empty table gives an empty result;
only the key and the text are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .scratch import Scratch

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Texts that can hold a match, for a fast first look.
_FIRST_LOOK = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""
MIN_LENGTH, MIN_DIGITS, MIN_LETTERS = 20, 2, 2
MAX_LABELLED = 2000
ALPHA = 0.01

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80

# Symbol classes, and how often ordinary text has them.
CLASSES = {"d": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ", "s": "+/_=-."}
ORDINARY = {"d": 0.05, "a": 0.24, "g": 0.61, "A": 0.02, "G": 0.05, "s": 0.03}
_CLASS = {c: k for k, cs in CLASSES.items() for c in cs}

# Public credential formats as (prefix, alphabet, shortest, longest).
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
FORMATS = {
    "hex_digest": ("", _DIGITS + "abcdef", 24, 64),
    "access_key": ("AKIA", _UPPER + _DIGITS, 16, 16),
    "base64_key": ("", _UPPER + _LOWER + _DIGITS + "+/", 40, 44),
    "prefixed_token": ("ghp_", _UPPER + _LOWER + _DIGITS, 36, 36),
    "upper_key": ("", _UPPER + _DIGITS, 20, 32),
}


def examples(per_format: int = 300, seed: int = 11) -> dict[str, list[str]]:
    """Labelled credentials drawn from the public formats' rules."""
    rng = np.random.default_rng(seed)
    return {kind: [prefix + "".join(rng.choice(list(letters), rng.integers(a, b + 1))) for _ in range(per_format)] for kind, (prefix, letters, a, b) in FORMATS.items()}


def symbols(text: str) -> str:
    return "".join(_CLASS.get(c, "o") for c in text)


class Automaton:
    """A probabilistic automaton merged from a prefix tree's compatible states."""

    def __init__(self, samples: list[str], alpha: float = ALPHA):
        self.count, self.ends, self.next = [0], [0], [{}]
        for text in samples:
            state = 0
            self.count[0] += 1
            for c in symbols(text):
                if c not in self.next[state]:
                    self.next[state][c] = len(self.count)
                    self.count.append(0)
                    self.ends.append(0)
                    self.next.append({})
                state = self.next[state][c]
                self.count[state] += 1
            self.ends[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self.probability = [{c: self.count_on[s].get(c, 0) / max(1, self.count[s]) for c in self.next[s]} for s in range(len(self.count))]

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        """Ends and every symbol as frequent, there and in what follows."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self.count[a], self.count[b]
            if self._differ(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if self._differ(self.count_on[a].get(c, 0), n1, self.count_on[b].get(c, 0), n2):
                    return False
                if c in self.next[a] and c in self.next[b]:  # b's states are a tree, so this ends
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree at b to the automaton at a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.ends[a] += self.ends[b]
            for c, child in self.next[b].items():
                self.count_on[a][c] = self.count_on[a].get(c, 0) + self.count_on[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge_all(self) -> None:
        self.count_on = [{c: self.count[t] for c, t in on.items()} for on in self.next]
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            parent, c = blue.pop(0)
            state = self.next[parent][c]
            if state in red:
                continue
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            blue = [(r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in red]

    def score(self, text: str) -> float:
        """Bits by which a symbol is likelier here than in ordinary text, on average."""
        state, total = 0, 0.0
        for c in (marks := symbols(text)):
            p = self.probability[state].get(c, 0.0)
            if p <= 0:
                return -20.0
            total += math.log2(p / ORDINARY.get(c, 0.01))
            state = self.next[state][c]
        return total / max(1, len(marks))


class Model:
    """An automaton and a least score for each kind of credential."""

    def __init__(self, labelled: dict[str, list[str]], floor: float = 0.5):
        self.parts = []
        for samples in (labelled[k] for k in sorted(labelled)):
            if len(samples) >= 20:
                automaton = Automaton(samples)
                scores = sorted(s for s in map(automaton.score, samples) if s > -20)
                if scores:
                    self.parts.append((automaton, max(floor, scores[len(scores) // 50] - 0.25)))

    def __call__(self, text: str) -> bool:
        return any(a.score(text) >= least for a, least in self.parts)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of the fixed patterns' spans, by start."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(found)


def _candidates(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(row, start, end, run) in code points."""
    begin, end, first = T.spans(_RUN[data], offsets)
    long = np.flatnonzero(end - begin >= MIN_LENGTH)
    if not len(long):
        return []
    rows = np.searchsorted(first, long, side="right") - 1
    chars = np.concatenate([[0], np.cumsum(_HEAD[data])])
    out = []
    for k, row in zip(long, rows, strict=True):
        a, b = int(begin[k]), int(end[k])
        run = data[a:b]
        if _DIGIT[run].sum() >= MIN_DIGITS and _LETTER[run].sum() >= MIN_LETTERS:
            start = int(chars[a] - chars[offsets[row]])
            out.append((int(row), start, start + b - a, run.tobytes().decode()))
    return out


_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fixed-pattern spans (``base``) and candidates for the grammars of each text."""
    kind = dict(docs.select(key).dtypes)[key]
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))
    shape = lambda found: [{"start": s, "kind": k, "stop": e, "value": v} for s, k, e, v in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            likely = pc.match_substring_regex(texts, _FIRST_LOOK).to_numpy(zero_copy_only=False)
            base = [base_spans(texts[i].as_py()) if likely[i] else [] for i in range(len(texts))]
            other: list[list] = [[] for _ in base]
            starts = [[s for s, _, _, _ in row] for row in base]
            ends = [list(accumulate((e for _, _, e, _ in row), max)) for row in base]

            def free(row: int, a: int, b: int, starts: list = starts, ends: list = ends) -> bool:
                """Whether no fixed span, of those by start, meets a..b."""
                before = bisect_left(starts[row], b)
                return not before or ends[row][before - 1] <= a

            for i, _, data, offsets in T.slices(texts):
                for row, a, b, value in _candidates(data, offsets):
                    if free(i + row, a, b):
                        other[i + row].append((a, 3, b, value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(shape, base), span), pa.array(map(shape, other), span)], [key, "base", "candidates"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, base {_SPAN}, candidates {_SPAN}")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", labelled: dict[str, list[str]] | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``base`` and ``added`` spans of each text.

    ``labelled``: credentials by kind; by default the public formats' examples and,
    of what the patterns found, the ``max_labelled`` distinct ones first by hash.
    """
    found = Scratch(docs.sparkSession, "secrets").save(spans(docs, text, key), "spans")
    if labelled is None:
        labelled = examples()
        values = found.where(F.size("base") > 0).select(F.explode("base").alias("b")).select("b.kind", "b.value").distinct()
        for r in values.orderBy(F.xxhash64("value"), "value", "kind").limit(max_labelled).collect():
            labelled.setdefault(f"found_{KINDS[r['kind']]}", []).append(r["value"])
    model = Model(labelled)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [[c for c in row if model(c["value"])] if row else [] for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, batch.column(2).type)], [key, "base", "added"])

    kind = dict(found.select(key).dtypes)[key]
    return found.mapInArrow(judge, f"`{key}` {kind}, base {_SPAN}, added {_SPAN}")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind, a hash of the base spans and all spans as text."""
    names = F.array(*(F.lit(k) for k in KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


