"""Label-free cleaning of coded survey columns, as projections.

Missing values are NULL throughout; ``nan_to_null`` is for sources that write NaN.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Codes = Mapping[str, tuple[Iterable[float], Iterable[float]]]


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN becomes NULL in the named columns (all double ones by default)."""
    names = columns or tuple(c for c, t in df.dtypes if t in ("double", "float"))
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def codes_to_null(df: DataFrame, rules: Codes) -> DataFrame:
    """Per column: missing codes become NULL, zero codes 0."""

    def clean(c: str, missing: Iterable[float], zero: Iterable[float]) -> Column:
        value = F.col(c)
        kept = F.when(~value.isin(*missing), value) if (missing := list(missing)) else value
        return F.when(value.isin(*zero), F.lit(0.0)).otherwise(kept) if (zero := list(zero)) else kept

    return df.withColumns({c: clean(c, m, z) for c, (m, z) in rules.items()})


def unit_codes(value: Column, factors: Mapping[int, float]) -> Column:
    """Codes ``unit * 100 + k`` as ``k`` times the unit's factor; other units stay as they are."""
    unit, k = F.floor(value / 100), value % 100
    out = value
    for u, f in factors.items():
        out = F.when(unit == u, k * F.lit(float(f))).otherwise(out)
    return out


def months_before(value: Column, month: Column, unknown_month: int = 77, middle: float = 6.5, first_year: int = 1900) -> Column:
    """Months from a ``mmyyyy`` code to ``month`` (months since year 0), not below 0; NULL for impossible years."""
    mm, yyyy = F.floor(value / 10000), value % 10000
    months = month - (12 * yyyy + F.when(mm == unknown_month, F.lit(middle)).otherwise(mm))
    return F.when((yyyy >= first_year) & months.isNotNull(), F.greatest(months, F.lit(0.0)))


def fill_by_gates(df: DataFrame, rules: Sequence[tuple[Mapping[str, Iterable[float]], Mapping[str, float]]]) -> DataFrame:
    """For each rule in order: where all gate columns hold one of their values, NULLs become the fill.

    A later rule sees earlier fills; a rule whose gate columns aren't all there is skipped.
    """
    for gates, fills in rules:
        if all(g in df.columns for g in gates):
            gate = F.lit(True)
            for g, values in gates.items():
                gate = gate & F.col(g).isin(*values)
            df = df.withColumns({c: F.when(gate & F.col(c).isNull(), F.lit(float(v))).otherwise(F.col(c)) for c, v in fills.items() if c in df.columns})
    return df


def digitize(value: Column, edges: Sequence[float]) -> Column:
    """The number of edges at or below the value; NULL stays."""
    total = F.lit(0)
    for e in edges:
        total = total + (value >= e).cast("int")
    return total


def any_answer(*columns: str) -> Column:
    """Whether any of the columns holds a value."""
    return F.coalesce(*(F.col(c).isNotNull() & F.lit(True) for c in columns)) if len(columns) == 1 else F.greatest(*(F.col(c).isNotNull() for c in columns))
