import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import jobs, linear, models, sampling, transforms, validation
from loomwork.sources import results


def rows_of(spark, n=600, seed=1, nulls=0.1):
    rng = np.random.default_rng(seed)
    a, b = rng.gamma(2, 3, n).round(2), rng.normal(0, 1, n).round(3)
    y = np.where(rng.random(n) < 1 / (1 + np.exp(-(0.4 * a - 3 + b))), 1, -1)
    gone = rng.random(n) < nulls
    data = [(i, None if gone[i] else float(a[i]), float(b[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(data, "id long, a double, b double, y int"), np.where(gone, np.nan, a), b, y


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_partial_correlations_of_curves(spark, degree):
    rng = np.random.default_rng(degree)
    n, d = 400, 20
    x = rng.gamma(1.5, 2, (n, d)) * rng.choice([0.1, 1, 30], d) - 5
    x[:, 3], x[:, 5] = 4.0, np.nan
    x[:, 7] = rng.integers(0, 2, n)
    x[rng.random((n, d)) < 0.05] = np.nan
    x[:, 3] = 4.0
    y = (rng.random(n) < 1 / (1 + np.exp(-np.sqrt(np.nan_to_num(x[:, 0] + 5)) + 1))).astype(float)
    y[:9] = np.nan
    data = [tuple(None if np.isnan(v) else float(v) for v in (*x[i], y[i])) for i in range(n)]
    names = [f"c.{i}" for i in range(d)]
    df = spark.createDataFrame(data, ", ".join(f"`{c}` double" for c in names) + ", y double")
    got = {r.column: r for r in transforms.gains(df, names, F.col("y"), degree).collect()}
    assert list(got) == names

    def corr(u, v):
        u, v = u - u.mean(), v - v.mean()
        return u @ v / np.sqrt((u @ u) * (v @ v)) if (u @ u) * (v @ v) > 1e-18 else 0.0

    for i, c in enumerate(names):
        has = ~np.isnan(x[:, i]) & ~np.isnan(y)
        v, t, r = x[has, i], y[has], got[c]
        assert r.n == has.sum()
        if not r.n:
            assert r.r is None and r.partial_sqrt is None and r.noise is None
            continue
        if v.std() == 0:
            assert (r.r, r.r_sqrt, r.partial_sqrt, r.partial_log1p) == (0, 0, 0, 0)
            continue
        far = v - np.nanmin(x[~np.isnan(y), i])
        curves = [np.sqrt(far), np.log1p(far)]
        basis = np.column_stack([((v - v.mean()) / v.std()) ** p for p in range(degree + 1)])
        rest = lambda u: u - basis @ np.linalg.lstsq(basis, u, rcond=None)[0]  # noqa: B023, E731
        assert (r.r, r.r_sqrt, r.r_log1p) == pytest.approx([corr(u, t) for u in (v, *curves)], abs=1e-9)
        assert r.noise == pytest.approx(2 / np.sqrt(r.n))
        want = [0.0, 0.0] if i == 7 else [corr(rest(u), rest(t)) for u in curves]  # two values: a line gives every curve
        assert (r.partial_sqrt, r.partial_log1p) == pytest.approx(want, abs=1e-6)
    assert [r.n for r in transforms.gains(df.where("y > 5"), names[:2], F.col("y")).collect()] == [0, 0]
    assert transforms.gains(df, [], F.col("y")).count() == 0
    with pytest.raises(ValueError):
        transforms.gains(df, names, F.col("y"), 0)


def test_dispatch_and_its_errors(spark):
    df, _, b, y = rows_of(spark, nulls=0)
    a = np.array([r.a for r in df.orderBy("id").collect()])
    x = np.column_stack([np.ones(len(y)), a, b])
    for wrong in ({"method": "nothing"}, {"method": "least_squares", "depth": 3}, {"method": "reg_logistic_newton", "positive": 2.0}):
        with pytest.raises(ValueError):
            models.fit(wrong.pop("method"), df, ["a", "b"], "y", "id", **wrong)
    with pytest.raises(ValueError):
        models.default_threshold("nothing")
    squares = models.fit("least_squares", df, ["a", "b"], "y", "id")
    w = np.linalg.lstsq(x, y, rcond=None)[0]
    assert squares.weights == pytest.approx(w, abs=1e-8) and squares.loss == pytest.approx(((y - x @ w) ** 2).mean() / 2)
    got = df.select("id", squares.predict().alias("p"), squares.predict(0.5).alias("q")).orderBy("id").collect()
    assert [r.p for r in got] == np.where(x @ w >= 0, 1, -1).tolist() and [r.q for r in got] == np.where(x @ w >= 0.5, 1, -1).tolist()
    t, v, s = (y == 1).astype(float), np.zeros(3), np.where(y == 1, 3.0, 1.0)
    for _ in range(30):
        v = v - 0.05 * x.T @ (s * (1 / (1 + np.exp(-x @ v)) - t)) / s.sum()
    weighted = models.fit("logistic_regression", df, ["a", "b"], "y", "id", penalty=9.0, rate=0.05, steps=30, positive=3.0)
    assert weighted.weights == pytest.approx(v, abs=1e-9)
    assert weighted.loss == pytest.approx((s * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ v))).sum() / s.sum())


@pytest.mark.parametrize("method", models.METHODS)
def test_every_method_beats_chance(spark, method):
    df, *_ = rows_of(spark, 500, nulls=0)
    some = {"reg_logistic_sophia": {"batch": 256}, "reg_logistic_unixgrad": {"radius": 2.0}}  # of the default radius, 20 steps don't settle
    options = {"n_trees": 4, "min_rows": 20} if method in models.TREES else some.get(method, {})
    rate = 0.002 if method == "mean_squared_error_sgd" else 0.02
    made = models.fit(method, df, ["a", "b"], "y", "id", penalty=1e-4, rate=rate, steps=20 if method not in models.SQUARES else 200, per_positive=1.0, **options)
    means = dict(df.groupBy("y").agg(F.avg(made.score())).collect())
    assert means[1] > means[-1] and np.isfinite(made.loss)
    if method not in models.SQUARES:
        assert 0 <= means[-1] and means[1] <= 1 and made.loss < np.log(2)


def test_many_features_make_a_shallow_expression(spark):
    names = [f"n.{i}" for i in range(700)]
    df = spark.range(3).select(*(F.lit(float(i % 5)).alias(c) for i, c in enumerate(names)))
    w = np.linspace(-1, 1, 701)
    assert df.select(models.margin(names, w).alias("z")).first().z == pytest.approx(w[0] + (w[1:] * (np.arange(700) % 5)).sum())


def best_cut(score, y):
    cuts = [(2 * ((score >= s) & y).sum() / ((score >= s).sum() + y.sum()), s) for s in np.unique(score)]
    return max(cuts)


def test_folds_against_a_loop(spark):
    df, a, b, y = rows_of(spark)
    grid = [{"penalty": 0.01}, {"penalty": 0.3}]
    types = {"a": "continuous", "b": "continuous"}
    out = jobs.validate(df, "y", "id", types, {"degree": 2}, "ridge_regression", grid, F.col("b") > 2, k=3)
    single = jobs.validate(df, "y", "id", types, {"degree": 2}, "ridge_regression", [{**grid[1], "rate": 0.1}], F.col("b") > 2, k=3)[0]
    assert single.folds == {n: pytest.approx(v) for n, v in out[1].folds.items()}
    for g, o in zip(grid, out, strict=True):
        held = {r.key: r for r in o.held.collect()}
        fold = np.array([held[i].fold for i in range(len(y))])
        assert sorted(held) == list(range(len(y)))
        for k in range(3):
            own = fold != k
            fa = np.where(np.isnan(a), np.nanmedian(a[own]), a)
            unit = lambda v: (v - v[own].mean()) / v[own].std()  # noqa: B023, E731
            za, zb = unit(fa), unit(b)
            x = np.column_stack([np.ones(len(y)), za, zb, unit(za**2), unit(zb**2)])
            w = np.linalg.solve(x[own].T @ x[own] + 2 * own.sum() * g["penalty"] * np.eye(5), x[own].T @ y[own])
            score = x @ w
            _, cut = best_cut(score[own], y[own] == 1)
            assert [held[i].score for i in np.flatnonzero(~own)] == pytest.approx(score[~own], abs=1e-8)
            f1 = lambda hit: 2 * (hit & (y == 1))[~own].sum() / (hit[~own].sum() + (y == 1)[~own].sum())  # noqa: B023, E731
            want = {"f1": f1(score >= cut - 1e-9), "f1_default": f1(score >= 0), "f1_rule": f1((score >= cut - 1e-9) | (b > 2)), "f1_val_best": best_cut(score[~own], y[~own] == 1)[0], "threshold": cut, "n_features": 5}
            assert {n: o.folds[n][k] for n in want} == pytest.approx(want, abs=1e-8)
    assert jobs.best(out).params in grid
    out[0].folds["threshold"][0] = float("inf")
    assert jobs.best(out) is out[1] and jobs.best([out[0]]) is None


@pytest.mark.parametrize("ids", [1000, 30, 1])
@pytest.mark.parametrize("copies", [False, True])
def test_folds_start_at_hashes(spark, ids, copies):
    """Equal to ranks for keys of their own; of exact sizes where rows share keys or are copies."""
    n = 311
    df = spark.createDataFrame([(i % ids, None if i % 10 == 3 else int(i % 10 == 0), 0 if copies else i) for i in range(n)], "id long, y int, v int")
    dealt, ranked = (f(df, "y", "id", 4).collect() for f in (sampling.dealt_folds, sampling.stratified_folds))
    count = lambda rows: {(f, y): sum(r.fold == f and r.y == y for r in rows) for f in range(4) for y in (0, 1, None)}
    assert count(dealt) == count(ranked) and len(dealt) == n
    if ids == 1000:
        assert sorted(map(repr, dealt)) == sorted(map(repr, ranked))
    assert sampling.dealt_folds(df.where("id < 0"), "y", "id", 4).count() == 0
    few = df.where("v < 3" if not copies else "id < 1").limit(3)
    assert sorted(r.fold for r in sampling.dealt_folds(few.where("y = 0"), "y", "id", 4).collect()) == sorted(r.fold for r in sampling.stratified_folds(few.where("y = 0"), "y", "id", 4).collect())


def test_grid_at_once_is_the_grid_one_by_one(spark):
    df, *_ = rows_of(spark, 700, nulls=0)
    grid = validation.param_grid(penalty=[0.01, 0.5])
    score = lambda w: w[0] + float(w[1]) * F.col("a") + float(w[2]) * F.col("b")

    def fit(folds, k, grid):
        found = linear.ridge_by_fold(folds, ["a", "b"], "y", "fold", k, [g["penalty"] for g in grid])
        return [[score([F.lit(float(w[0])), *w[1:]]) for w in found[g["penalty"]]] for g in grid]

    def one(train, penalty):
        w = linear.ridge(train, ["a", "b"], "y", [penalty])[penalty]
        return score([F.lit(float(w[0])), *w[1:]])

    got, want = validation.grid_at_once(df, "y", "id", grid, fit, 3), validation.grid_search(df, "y", "id", grid, one, 3)
    assert [r["penalty"] for r in got] == [r["penalty"] for r in want]
    assert [(r["f1"], r["std"]) for r in got] == [pytest.approx((r["f1"], r["std"]), abs=1e-9) for r in want]


def test_final_and_averaged_models(spark, tmp_path):
    df, *_ = rows_of(spark, 500)
    test = df.where("id < 120").drop("y").withColumn("a", F.col("a") + 1)
    test = test.union(test.where("id < 3")).withColumn("score", F.lit("other")).withColumn("bias", F.lit(7))
    types = {"a": "continuous", "b": "continuous"}
    newton = jobs.Setting("reg_logistic_newton", types, {"curves": ["sqrt"]}, {"penalty": 1e-3, "steps": 10})
    trees = jobs.Setting("gradient_boosting", types, {}, {"n_trees": 3, "min_rows": 20})
    figures, made = jobs.final(df, test, "y", "id", newton, F.col("b") < -1, k=2)
    results.save_result(spark, f"{tmp_path}/r.json", figures)
    assert results.load_result(spark, f"{tmp_path}/r.json") == figures
    known = {r.id for r in df.where("b < -1").collect()}
    rows = made.collect()
    assert len(rows) == 123 and all(r.predicted == (1 if r.score >= figures["threshold_oof"] or r.key in known else -1) for r in rows)
    assert any(r.score < figures["threshold_oof"] and r.key in known for r in rows) and figures["n_features_final"] == 5 and len(figures["f1"]) == 2
    one, two = (dict(jobs.component(df, "y", "id", s).scored(test.select("id", "a", "b")).select("id", "score").collect()) for s in (newton, trees))
    both = jobs.averaged(df, test, "y", "id", newton, trees, 0.25, 0.4).collect()
    assert len(both) == 123
    for r in both:
        assert r.score == pytest.approx(0.25 * one[r.key] + 0.75 * two[r.key]) and r.predicted == (1 if r.score >= 0.4 else -1)
    assert jobs.component(df, "y", "id", newton).scored(test.where("id < 0")).count() == 0
