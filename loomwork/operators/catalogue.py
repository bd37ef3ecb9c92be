"""A survey's column catalogue as a table of rules, compiled into the label-free cleaning plan.

A catalogue says for each column its type, its codes for missing and for none, why it is left
out and what it is converted to; and for the survey its gates (skip logic), conversions with the
columns they are bound to, and bins. ``clean`` compiles it: codes, conversions, gates, bins.
Gates that read columns filled by earlier ones go to later levels; a level is one projection
that names each column once, so the plan grows with the rules, not with their chains, and the
table is scanned once.

Columns the catalogue doesn't know get the default codes; rules, conversions and bins of
absent columns are skipped, as are gates of which a column is absent; a conversion whose bound
columns are absent raises ``KeyError``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cleaning

# Factors of the units 1 to 4 (day, week, month, year).
TIMES_PER_YEAR = {1: 365.0, 2: 52.0, 3: 12.0, 4: 1.0}
YEARS = {1: 1 / 365, 2: 1 / 52, 3: 1 / 12, 4: 1.0}
#: Codes of columns without a rule: missing, none.
DEFAULT_CODES: tuple[tuple[float, ...], tuple[float, ...]] = ((7.0, 9.0), ())
_FACTORS = {"rate": TIMES_PER_YEAR, "duration": YEARS}


@dataclass(frozen=True)
class Conversion:
    """``kind`` rate or duration (unit codes), months (``mmyyyy`` before the bound year and month) or recode (``values``).

    ``values``: codes that become other values; of a duration, ``bound`` names the column whose value ``whole`` stands for.
    """

    kind: str
    bound: tuple[str, ...] = ()
    whole: float | None = None
    values: Mapping[float, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Catalogue:
    """``left_out``: group ("domain", "redundant", "converted", "leakage" or a selection rule) to its columns."""

    types: Mapping[str, str] = field(default_factory=dict)
    codes: Mapping[str, tuple[Sequence[float], Sequence[float]]] = field(default_factory=dict)
    gates: Sequence[tuple[Mapping[str, Sequence[float]], Mapping[str, float]]] = ()
    conversions: Mapping[str, Conversion] = field(default_factory=dict)
    bins: Mapping[str, Sequence[float]] = field(default_factory=dict)
    left_out: Mapping[str, Sequence[str]] = field(default_factory=dict)

    @classmethod
    def read(cls, text: str) -> Catalogue:
        """From JSON with the same names; a conversion's ``values`` and codes are written as lists of pairs and numbers."""
        raw = json.loads(text)
        unknown = set(raw) - {"types", "codes", "gates", "conversions", "bins", "left_out"}
        if unknown:
            raise ValueError(f"unknown parts of a catalogue: {sorted(unknown)}")
        made = {c: Conversion(v["kind"], tuple(v.get("bound", ())), v.get("whole"), dict(v.get("values", []))) for c, v in raw.get("conversions", {}).items()}
        return cls(raw.get("types", {}), {c: tuple(map(tuple, v)) for c, v in raw.get("codes", {}).items()}, [tuple(g) for g in raw.get("gates", [])], made, raw.get("bins", {}), raw.get("left_out", {}))

    def special_codes(self, names: Iterable[str]) -> dict[str, tuple[Sequence[float], Sequence[float]]]:
        """Codes of each column, the default ones where it has no rule."""
        return {c: self.codes.get(c, DEFAULT_CODES) for c in names}

    def not_selected(self, rules: Iterable[str] | bool, fixed: Sequence[str] = ("domain", "redundant", "converted", "leakage")) -> list[str]:
        """Columns under some selection rules, or under all with True."""
        known = [r for r in self.left_out if r not in fixed]
        rules = known if rules is True else list(rules or ())
        if unknown := sorted(set(rules) - set(known)):
            raise ValueError(f"unknown selection rules {unknown}, there are {known}")
        return [c for r in rules for c in self.left_out[r]]

    def candidates(self, names: Sequence[str], domain: bool = True, redundant: bool = True, select: Iterable[str] | bool = (), convert: bool = True, keep_leakage: bool = False) -> list[str]:
        """``names`` that can be features; leakage goes with any setting, unless it is kept against all of them."""
        group = lambda g: set(self.left_out.get(g, ()))
        drop = set(self.not_selected(select))
        for on, g in ((domain, "domain"), (redundant, "redundant"), (convert, "converted")):
            drop |= group(g) if on else set()
        drop = drop - group("leakage") if keep_leakage else drop | group("leakage")
        return [c for c in names if c not in drop]


def _converted(c: str, rule: Conversion) -> Column:
    value = F.col(c)
    if rule.kind == "months":
        year, month = map(F.col, rule.bound)
        return cleaning.months_before(value, 12 * year + month)
    if rule.kind == "recode":
        out = value
        for old, new in rule.values.items():
            out = F.when(value == float(old), F.lit(float(new))).otherwise(out)
        return out
    if rule.kind not in _FACTORS:
        raise ValueError(f"unknown conversion {rule.kind!r} of {c}")
    out = cleaning.unit_codes(value, _FACTORS[rule.kind])
    return out if rule.whole is None else F.when(value == rule.whole, F.col(rule.bound[0])).otherwise(out)


def convert_units(df: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Each conversion on cleaned codes; all read the columns as they were before."""
    own = {c: r for c, r in catalogue.conversions.items() if c in df.columns}
    if lost := sorted({b for r in own.values() for b in r.bound} - set(df.columns)):
        raise KeyError(f"columns that conversions are bound to are absent: {lost}")
    return df.withColumns({c: _converted(c, r) for c, r in own.items()})


def gate_levels(catalogue: Catalogue, names: Iterable[str]) -> list[list[tuple[Mapping[str, Sequence[float]], Mapping[str, float]]]]:
    """The gates that apply, in levels: within one, no gate reads or fills a column that another fills."""
    names, levels = set(names), []
    written: dict[str, int] = {}  # the last level that fills a column
    read: dict[str, int] = {}
    for gate, fills in catalogue.gates:
        if not set(gate) <= names:
            continue
        fills = {c: v for c, v in fills.items() if c in names}
        at = max([-1, *(written.get(c, -1) for c in gate), *(written.get(c, -1) for c in fills)]) + 1
        at = max([at, *(read.get(c, 0) for c in fills)])  # an earlier gate still sees the column as it was
        while len(levels) <= at:
            levels.append([])
        levels[at].append((gate, fills))
        written.update(dict.fromkeys(fills, at))
        for c in gate:
            read[c] = max(read.get(c, 0), at)
    return levels


def fill_gates(df: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Skip logic: nulls of questions that a gate's answers leave out get its fill, a projection for each level."""
    for level in gate_levels(catalogue, df.columns):
        made: dict[str, Column] = {}
        for gate, fills in level:
            asked = F.lit(True)
            for g, answers in gate.items():
                asked = asked & F.col(g).isin(*map(float, answers))
            made |= {c: F.coalesce(F.col(c), F.when(asked, F.lit(float(v)))) for c, v in fills.items()}
        df = df.withColumns(made)
    return df


def clean(df: DataFrame, catalogue: Catalogue, key: str | None = None, convert: bool = True, skip_logic: bool = True, binning: bool = True) -> DataFrame:
    """Codes to null or 0, conversions, skip logic and bins, in this order; ``key`` stays as it is."""
    df = cleaning.codes_to_null(df, catalogue.special_codes(c for c in df.columns if c != key))
    if convert:
        df = convert_units(df, catalogue)
    if skip_logic:
        df = fill_gates(df, catalogue)
    if binning:
        df = df.withColumns({c: cleaning.digitize(F.col(c), edges).cast("double") for c, edges in catalogue.bins.items() if c in df.columns})
    return df
