"""Best cuts of many scores at once: counts by range of scores, bounds that rule ranges out, and an exact search in the ranges that are left."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import fbeta

#: Ranges of a score's values that one scan counts.
RANGES = 1024
#: Rows in open ranges that are few enough to be put in order, and scans that narrow the ranges before, at most.
FEW, SCANS = 1 << 18, 4


def _ranges(s: pa.Array, cell: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(range, cell, score) of the rows that have both; NaN lies above all scores."""
    has = (cell >= 0) & s.is_valid().to_numpy(zero_copy_only=False)
    score, own = s.to_numpy(zero_copy_only=False)[has], cell[has]
    order = np.argsort(score)  # neighbours are found faster
    return np.searchsorted(edges, score[order], side="right"), own[order], score[order]


def _edges(rows: DataFrame, scores: int, ranges: int, of_task: int = 128) -> list[np.ndarray]:
    """About ``ranges`` - 1 quantiles of each score: evenly spaced ones of each batch, of which a task gives ``of_task``."""

    def some(values: np.ndarray, n: int) -> np.ndarray:
        return values if len(values) <= n else values[np.linspace(0, len(values) - 1, n).round().astype(int)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = [[] for _ in range(scores)]
        for batch in batches:
            for i, kept in enumerate(found):
                s = batch.column(i + 1).drop_null().to_numpy(zero_copy_only=False)
                kept.append(some(np.sort(s[np.isfinite(s)]), of_task))
        for i, kept in enumerate(found):
            values = some(np.sort(np.concatenate([*kept, []])), of_task)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i, np.int32)), pa.array(values)], ["score", "s"])

    found = rows.mapInArrow(run, "score int, s double").toArrow()
    which, s = (found[c].to_numpy() for c in ("score", "s"))
    at = np.arange(1, ranges) / ranges
    return [np.unique(np.quantile(own, at, method="lower")) if len(own := s[which == i]) else np.array([]) for i in range(scores)]


def _counted(rows: DataFrame, edges: Sequence[np.ndarray], cells: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Rows by range and cell, and the least and greatest finite score of each range, for each score."""
    columns = [f"c{j}" for j in range(cells)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(e) + 1) * cells, np.int64) for e in edges]
        lows, highs = ([np.full(len(e) + 1, v) for e in edges] for v in (np.inf, -np.inf))
        for batch in batches:
            cell = batch.column(0).to_numpy()
            for i, e in enumerate(edges):
                at, own, score = _ranges(batch.column(i + 1), cell, e)
                totals[i] += np.bincount(at * cells + own, minlength=len(totals[i]))
                finite = np.isfinite(score)
                np.minimum.at(lows[i], at[finite], score[finite])
                np.maximum.at(highs[i], at[finite], score[finite])
        for i, total in enumerate(totals):
            table = total.reshape(-1, cells)
            at = np.flatnonzero(table.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(lows[i][at]), pa.array(highs[i][at]), *(pa.array(table[at, j]) for j in range(cells))], ["score", "range", "low", "high", *columns])

    found = rows.mapInArrow(run, "score int, range int, low double, high double, " + ", ".join(f"{c} long" for c in columns))
    found = found.groupBy("score", "range").agg(F.min("low").alias("low"), F.max("high").alias("high"), *(F.sum(c).alias(c) for c in columns)).toArrow()  # ``RANGES`` rows a score
    which, at = (found[c].to_numpy() for c in ("score", "range"))
    counts, lows, highs = ([np.zeros((len(e) + 1, cells), np.int64) for e in edges], *([np.full(len(e) + 1, v) for e in edges] for v in (np.inf, -np.inf)))
    for i in range(len(edges)):
        own = which == i
        counts[i][at[own]] = np.column_stack([found[c].to_numpy()[own] for c in columns])
        lows[i][at[own]], highs[i][at[own]] = found["low"].to_numpy()[own], found["high"].to_numpy()[own]
    return counts, lows, highs


def _bounds(counts: np.ndarray, view: Sequence[int]) -> tuple[float, np.ndarray]:
    """(the best F1 at the end of a range, a bound of the F1 inside each range) over the folds of ``view``; -1 where a range has no rows of these."""
    p, n = (counts[:, [2 * k + j for k in view]].sum(1) for j in (0, 1))
    tp, fp = (np.cumsum(v[::-1])[::-1] for v in (p, n))  # at the range's least score
    f1 = lambda tp, fp: 2 * tp / np.maximum(tp + fp + p.sum(), 1)
    here = p + n > 0
    if not p.any():  # no cut is better than the highest
        here &= np.cumsum(here[::-1])[::-1] == 1
    return float(np.where(here, f1(tp, fp), -1.0).max()), np.where(here, f1(tp, fp - n), -1.0)


def _opened(counts: Sequence[np.ndarray], views: Sequence[Sequence[int]], together: bool) -> list[np.ndarray]:
    """The ranges of each score that may hold the best cut of one of the views."""
    bounds = [[_bounds(c, v) for v in views] for c in counts]
    out = [np.zeros(len(c), bool) for c in counts]
    for i, own in enumerate(bounds):
        for v, (least, most) in enumerate(own):
            floor = max(b[v][0] for b in bounds) if together else least
            out[i] |= (most >= 0) & (most >= floor * (1 - 1e-9))
    return out


def _narrowed(edges: np.ndarray, open_: np.ndarray, low: np.ndarray, high: np.ndarray, ranges: int) -> np.ndarray:
    """``edges`` and those that divide each open range evenly between its scores; closed ranges stay as they are, as a bound is weak over several."""
    parts = max(2, ranges // max(1, open_.sum()))
    inside = [np.linspace(low[k], high[k], parts + 1)[1:-1] for k in np.flatnonzero(open_ & (low < high))]
    return np.unique(np.concatenate([edges, *inside]))


def best_cuts(df: DataFrame, scores: Sequence[str], positive: Column, fold: Column | None = None, folds: int = 1, views: Sequence[Sequence[int]] = ((0,),), together: bool = False, ranges: int = RANGES) -> dict[tuple[int, int], tuple[float, float]]:
    """{(number of the score, number of the view): (F1, cut)}: the cut at an actual score with the largest F1 on the rows of the view's folds, of several the highest.

    Exact whatever the ranges are. A scan counts rows by range of scores; a range whose every row could be a
    positive and still not reach the best F1 at the end of a range is ruled out, the others are divided and
    counted again while they hold many rows. Only rows in ranges still open are put in order, range by range.
    ``together``: only the best of all scores is asked for in each view, so scores that can't be best may be missing.
    Rows without a score, fold or label are left out.
    """
    own = F.lit(0) if fold is None else fold
    cell = F.when(own.between(0, folds - 1), own * 2 + F.when(positive, 0).when(~positive, 1))
    rows = df.select(F.coalesce(cell, F.lit(-1)).cast("int").alias("cell"), *(F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(scores)))
    edges = _edges(rows, len(scores), ranges)
    before = np.inf
    for scan in range(SCANS):
        counts, lows, highs = _counted(rows, edges, 2 * folds)
        open_ = _opened(counts, views, together)
        left = sum(int(c[o].sum()) for c, o in zip(counts, open_, strict=True))
        if left <= FEW or left > before / 2 or scan == SCANS - 1:
            break
        before, edges = left, [_narrowed(*x, ranges) for x in zip(edges, open_, lows, highs, strict=True)]
    if not left:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(0).to_numpy()
            for i, e in enumerate(edges):
                at, cell, score = _ranges(batch.column(i + 1), cells, e)
                kept = open_[i][at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(kept.sum()), i, np.int32)), pa.array(at[kept].astype(np.int32)), pa.array(score[kept]), pa.array(cell[kept])], ["score", "range", "s", "cell"])

    names = [f"c{j}" for j in range(2 * folds)]
    at = rows.mapInArrow(run, "score int, range int, s double, cell int").groupBy("score", "range", "s").agg(*(F.count_if(F.col("cell") == j).alias(c) for j, c in enumerate(names)))
    within = Window.partitionBy("score", "range").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    above = []
    for i, (c, o) in enumerate(zip(counts, open_, strict=True)):
        upto = np.cumsum(c[::-1], 0)[::-1] - c
        above += [(i, int(k), *map(int, upto[k]), *map(int, c.sum(0)[::2])) for k in np.flatnonzero(o)]
    schema = "score int, range int, " + ", ".join([f"{c}_above long" for c in names] + [f"all{k} long" for k in range(folds)])
    base = df.sparkSession.createDataFrame(above, schema)  # a row for each open range
    at = at.withColumns({f"{c}_here": F.sum(c).over(within) for c in names}).join(F.broadcast(base), ["score", "range"])

    def best(view: Sequence[int]) -> Column:
        add = lambda cells: sum(cells[1:], cells[0]) if cells else F.lit(0)
        tp, fp = (add([F.col(f"c{2 * k + j}_here") + F.col(f"c{2 * k + j}_above") for k in view]) for j in (0, 1))
        seen = add([F.col(f"c{2 * k + j}") for k in view for j in (0, 1)]) > 0  # a score of these rows
        return F.max(F.when(seen, F.struct(fbeta(tp, fp, add([F.col(f"all{k}") for k in view]) - tp).alias("f1"), F.col("s").alias("s"))))

    found = at.groupBy("score").agg(*(best(v).alias(f"v{i}") for i, v in enumerate(views))).collect()  # a row for each score
    return {(r["score"], i): (r[f"v{i}"].f1, r[f"v{i}"].s) for r in found for i in range(len(views)) if r[f"v{i}"] is not None}
