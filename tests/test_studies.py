import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomwork.operators import cuts, distributions, ensemble, linear, metrics, screening


def frame(spark, rng, n=3000):
    x = {"many": rng.normal(5, 2, n).round(3), "few": rng.integers(0, 6, n).astype(float), "ties": rng.integers(0, 400, n) ** 2.0, "empty": np.full(n, np.nan), "one": np.ones(n)}
    for c in ("many", "few"):
        x[c][rng.random(n) < 0.1] = np.nan
    y = rng.random(n) < 1 / (1 + np.exp(-(np.nan_to_num(x["many"], nan=5) - 6) + 0.2 * np.nan_to_num(x["few"]) ** 2))
    rows = [tuple(None if np.isnan(x[c][i]) else float(x[c][i]) for c in x) + (bool(y[i]), i) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in x) + ", y boolean, id long"), x, y


NAMES = ["many", "few", "ties", "empty", "one"]


@pytest.mark.parametrize("piece", [1 << 20, 50, 1])
def test_quantiles_of_all_columns(spark, piece):
    df, x, _ = frame(spark, np.random.default_rng(1), 700)
    levels = [0.0, 0.013, 0.5, 0.77, 1.0]
    got = {(r.column, r.level): r.quantile for r in distributions.quantiles(distributions.counted(df, NAMES), levels, piece).collect()}
    want = {(c, q): np.quantile(v[~np.isnan(v)], q) for c, v in x.items() if c != "empty" for q in levels}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert distributions.quantiles(distributions.counted(df.where("id < 0"), NAMES), levels).count() == 0


def groups_of(v, fit, wide):
    """The group of each value: itself, or the number of its range between deciles of ``fit``."""
    if not wide:
        return v
    e = np.unique(np.quantile(fit[~np.isnan(fit)], [i / 10 for i in range(11)]))
    return np.where(np.isnan(v), np.nan, np.clip(np.searchsorted(e, v, side="right") - 1, 0, len(e) - 2))


def test_log_odds_against_polynomial_fits(spark):
    df, x, y = frame(spark, np.random.default_rng(2))
    got = {r.column: r for r in distributions.log_odds_shapes(distributions.counted(df, NAMES, F.col("y")), by_value=["few"]).collect()}
    assert got.keys() == set(NAMES) and got["empty"].groups == 0 and got["one"].groups == 1 and got["one"].line is None and got["one"].signal is None
    for c in ("many", "few", "ties"):
        v = x[c]
        g = groups_of(v, v, c != "few")
        points = []
        for k in np.unique(g[~np.isnan(g)]):
            n, p = (g == k).sum(), y[g == k].mean()
            if n >= 30 and 0 < p < 1:
                points.append((v[g == k].mean(), np.log(p / (1 - p)), n * p * (1 - p)))
        a, b, w = np.array(points).T
        centre = np.average(b, weights=w)
        r2 = lambda d: 1 - (w * (b - np.polyval(np.polyfit(a, b, d, w=np.sqrt(w)), a)) ** 2).sum() / (w * (b - centre) ** 2).sum()  # noqa: B023, E731
        assert got[c].groups == len(points)
        assert (got[c].line, got[c].parabola, got[c].signal) == pytest.approx((r2(1), r2(2), (w * (b - centre) ** 2).sum() / (len(a) - 1)), abs=1e-7)


def test_shift_against_shares(spark):
    rng = np.random.default_rng(3)
    one, x1, _ = frame(spark, rng, 900)
    two, x2, _ = frame(spark, rng, 500)
    two = two.withColumn("few", F.col("few") + 3)
    x2["few"] = x2["few"] + 3
    part = np.arange(900) % 3 == 0

    def apart(a, b, wide):
        ga, gb = groups_of(a, a, wide), groups_of(b, a, wide)
        share = lambda g, k: (np.isnan(g) if k is None else g == k).mean()
        every = {*ga[~np.isnan(ga)], *gb[~np.isnan(gb)], None}
        return 0.5 * sum(abs(share(ga, k) - share(gb, k)) for k in every)

    got = {r.column: r for r in distributions.shift(one, two, NAMES, F.col("id") % 3 == 0).collect()}
    for c in NAMES:
        wide = c in ("many", "ties")
        want = np.isnan(x1[c]).mean(), np.isnan(x2[c]).mean(), apart(x1[c], x2[c], wide), apart(x1[c][~part], x1[c][part], wide)
        assert (got[c].missing_a, got[c].missing_b, got[c].distance, got[c].noise) == pytest.approx(want, abs=1e-9)


def test_codes_that_cleaning_kept_and_guesses_of_types(spark):
    rows = [(float(v), f, m, v % 2 == 0) for v, f, m in [(1, 0.5, None), (2, 1.0, None), (2, 2.0, None), (8, None, None), (9, 3.0, None), (88, 7.0, None)]]
    counts = distributions.counted(spark.createDataFrame(rows, "a double, b double, none double, y boolean"), ["a", "b", "none"], F.col("y"))
    kept = {(r.column, r.value): (r.gap, r.n, r.share, r.rate, r.other_rate) for r in distributions.kept_codes(counts, [7, 8, 9, 88]).collect()}
    assert kept == {("a", 8.0): (6.0, 1, 1 / 6, 1.0, 0.6), ("a", 88.0): (79.0, 1, 1 / 6, 1.0, 0.6), ("b", 7.0): (4.0, 1, 0.2, 1.0, 0.5)}
    codes = {"a": ((77,), (88,)), "b": ((7777,), ())}
    kind = lambda **more: {r.column: (r["values"], r.proposed) for r in distributions.proposed_types(counts, more.pop("codes", {}), **more).collect()}
    assert kind(codes=codes) == {"a": (5, "count"), "b": (5, "mixed_units"), "none": (0, "binary")}
    assert kind(dropped=["none"]) == {"a": (5, "categorical"), "b": (5, "continuous"), "none": (0, "drop")}
    assert kind(most_values=4)["a"] == (5, "continuous")


def best_by_hand(a, b, y, weights):
    """(f1, -weight, cut): every weight and every score as a cut."""
    found = []
    for w in weights:
        s = w * a + (1 - w) * b
        for cut in np.unique(s):
            hit = s >= cut
            tp = (hit & y).sum()
            found.append((2 * tp / (hit.sum() + y.sum()) if tp else 0.0, -w, cut))
    return max(found)


@pytest.mark.parametrize("ranges", [2, 7, 256])
def test_weights_of_two_models_against_all_cuts(spark, ranges):
    rng = np.random.default_rng(4)
    n, weights = 240, [0.0, 0.3, 0.6, 1.0]
    y = rng.random(n) < 0.3
    a, b = (y + rng.normal(0, 1, n)).round(1), (y + rng.normal(0, 0.8, n)).round(1)
    fold, known = rng.integers(0, 3, n), y & (rng.random(n) < 0.2)
    rows = [(float(a[i]), float(b[i]), bool(y[i]), int(fold[i]), bool(known[i]) if i % 2 else (True if known[i] else None)) for i in range(n)] + [(None, 1.0, True, 0, False)] * 3
    df = spark.createDataFrame(rows, "a double, b double, y boolean, fold int, known boolean")
    got = {r.fold: r for r in ensemble.weights_by_fold(df, "a", "b", F.col("y"), "fold", 3, weights, ranges).collect()}
    honest = {r.fold: r for r in ensemble.honest(df.where("a is not null"), "a", "b", F.col("y"), F.col("known"), "fold", 3, weights).collect()}
    assert got.keys() == {-1, 0, 1, 2} and honest.keys() == {0, 1, 2}
    for k, r in got.items():
        rest = fold != k
        f1, w, cut = best_by_hand(a[rest], b[rest], y[rest], weights)
        assert (r.f1, r.weight, r.threshold) == pytest.approx((f1, -w, cut))
        if k >= 0:
            own = fold == k
            hit = r.weight * a[own] + (1 - r.weight) * b[own] >= r.threshold
            f = lambda h: 2 * (h & y[own]).sum() / (h.sum() + y[own].sum())  # noqa: B023, E731
            assert (honest[k].weight, honest[k].f1, honest[k].f1_rule) == pytest.approx((r.weight, f(hit), f(hit | known[own])))
    serial = metrics.best_threshold(df.where("a is not null").withColumn("s", got[-1].weight * F.col("a") + (1 - got[-1].weight) * F.col("b")), "s", F.col("y")).first()
    assert (serial.threshold, serial.fbeta) == pytest.approx((got[-1].threshold, got[-1].f1))
    assert ensemble.weights_by_fold(df.where("a > 99"), "a", "b", F.col("y"), "fold", 3, weights).count() == 0


def shuffled(spark):
    """Rows that stages of this session have written to shuffles so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_weights_put_few_rows_in_order(spark, monkeypatch):
    monkeypatch.setattr(cuts, "FEW", 500)  # several scans
    rng = np.random.default_rng(6)
    n, weights = 30_000, [0.0, 0.5, 1.0]
    y = rng.random(n) < 0.3
    a, b, fold = y + rng.normal(0, 1, n), y + rng.normal(0, 0.8, n), rng.integers(0, 2, n)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": y, "fold": fold.astype(np.int32)})).persist()
    before = shuffled(spark)
    got = {r.fold: r for r in ensemble.weights_by_fold(df, "a", "b", F.col("y"), "fold", 2, weights, 64).collect()}
    assert shuffled(spark) - before < n / 2
    df.unpersist()
    for k, r in got.items():
        own, best = fold != k, (-1.0, 0.0, 0.0)
        for w in weights:
            s = (w * a + (1 - w) * b)[own]
            order = np.argsort(-s)
            tp = np.cumsum(y[own][order])
            f1 = 2 * tp / (np.arange(1, len(s) + 1) + tp[-1])
            best = max(best, (f1.max(), -w, s[order][f1.argmax()]))
        assert (r.f1, -r.weight, r.threshold) == pytest.approx(best, abs=1e-12)


@pytest.mark.parametrize("label", [True, False])
def test_cuts_of_odd_scores(spark, label):
    """Infinite and missing scores, NaN (above all), no positives, folds and labels that don't count."""
    rows = [(float("inf"), True, 0), (float("nan"), False, 0), (-0.0, True, 0), (0.0, True, 0), (-float("inf"), False, 0), (None, True, 0), (9.0, True, 7), (9.0, None, 0), (9.0, True, None)]
    df = spark.createDataFrame([(s, y and label if y is not None else None, f) for s, y, f in rows], "s double, y boolean, fold int")
    got = cuts.best_cuts(df, ["s"], F.col("y"), F.col("fold"), 1, ranges=4)
    if label:
        assert got == {(0, 0): (pytest.approx(6 / 7), 0.0)}
    else:
        assert got[0, 0][0] == 0.0 and np.isnan(got[0, 0][1])
    assert cuts.best_cuts(df.where("fold = 7"), ["s"], F.col("y"), F.col("fold"), 1) == {}


def test_groups_are_screened_as_one_by_one(spark):
    rng = np.random.default_rng(5)
    n = 1500
    x = rng.normal(0, 1, (n, 6)) * [1, 2, 5, 1, 0.1, 1] + [0, 1, 50, 0, 3, 0]
    x[:, 5] = 2 * x[:, 0] - x[:, 1]  # the model has it already
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1] + 0.1 * (x[:, 2] - 50))))).astype(int)
    std = (x - x.mean(0)) / x.std(0)
    names = [f"x{i}" for i in range(6)]
    raw, done = (spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(m, y, strict=True)], ", ".join(f"{c} double" for c in names) + ", y int") for m in (x, std))
    groups = {"strong": ["x2"], "noise": ["x3", "x4"], "both": ["x2", "x3", "x4"], "again": ["x5"]}
    for penalty in (0.0, 0.01):
        w = linear.newton_logistic(raw, ["x0", "x1"], "y", penalty)
        got = {r.group: r for r in screening.screen(raw, ["x0", "x1"], groups, "y", w, penalty, top=1).collect()}
        # the same model on standardized candidates: those of the raw model's columns stay raw
        mixed = raw.select("x0", "x1").columns
        table = spark.createDataFrame([(float(x[i, 0]), float(x[i, 1]), *map(float, std[i, 2:]), int(y[i])) for i in range(n)], ", ".join(f"{c} double" for c in names) + ", y int")
        for name, columns in groups.items():
            if name == "again" and not penalty:
                assert got[name].chi2 < 1e-3 and got[name].p > 0.9
                continue
            chi2, p = linear.score_test(table, mixed, columns, "y", w, penalty)
            assert (got[name].chi2, got[name].p, got[name].gain, got[name]["columns"]) == pytest.approx((chi2, p, chi2 / (2 * n), len(columns)), rel=1e-5, abs=1e-9)
        assert got["strong"].passes and got["both"].passes and not got["noise"].passes
        related = [abs(np.corrcoef(x[:, i], y)[0, 1]) for i in range(6)]
        assert all(got[g].leading == (max(related[int(c[1])] for c in cols) > max(related[:2])) for g, cols in groups.items())
    with pytest.raises(ValueError):
        screening.screen(raw.where("x0 > 99"), ["x0"], groups, "y", np.zeros(2))
