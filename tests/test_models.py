import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import linear, profiles, statistics, trees, validation
from loomwork.plans import queries as plans
from loomwork.sources import survey


@pytest.fixture(scope="module")
def xor(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) == (x[:, 1] > 0)).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, c double, y int").cache()


def accuracy(df, score):
    return df.agg(F.avg(((score >= 0.5).cast("int") == F.col("y")).cast("int"))).first()[0]


def test_best_split():
    sums = np.zeros((2, 10, 3))
    sums[0, :, 0] = sums[0, :, 2] = 20
    sums[0, 6:, 1] = 20
    sums[1, 0] = [200, 80, 200]
    assert trees.best_split(sums, 0.0, 1, [0, 1]) == (0, 5)
    assert trees.best_split(sums, 0.0, 150, [0, 1]) is None


def test_a_level_against_all_cuts(spark):
    rng = np.random.default_rng(5)
    n, reg, least = 700, 1.5, 40
    x = np.column_stack([rng.integers(0, 9, n), rng.normal(0, 1, n).round(2), np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 4, n))])
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 4) * np.where(x[:, 1] > 0.3, 1, -0.5)))).astype(float)
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in x[i]), float(y[i])) for i in range(n)], "id long, a double, b double, c double, y double")
    edges = trees.bin_edges(df, ["a", "b", "c"], "id", 16)
    for f in range(3):
        v = x[~np.isnan(x[:, f]), f]
        q = np.quantile(v, np.arange(16) / 16)
        assert edges[f] == pytest.approx(np.unique(q[q > q[0]]))
    model = trees.gradient_boosting(df, ["a", "b", "c"], "y", "id", n_trees=1, rate=1.0, depth=2, min_rows=least, reg=reg, subsample=1.0, colsample=1.0, n_bins=16)
    tree, p = model.trees[0], y.mean()
    bins = np.column_stack([sum((np.where(np.isnan(x[:, f]), np.inf, x[:, f]) >= e).astype(int) for e in edges[f]) for f in range(3)])
    g, h = y - p, np.full(n, p * (1 - p))

    def part(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + reg)

    def check(node, rows, depth):
        assert tree.value[node] == pytest.approx(g[rows].sum() / (h[rows].sum() + reg))
        found = []
        for f in range(3):
            for cut in range(16):
                left, right = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                if len(left) >= least and len(right) >= least:
                    found.append((part(left) + part(right) - part(rows), f, cut))
        gain = max(found, default=(0,))[0]
        if depth == 2 or gain <= 1e-12:
            assert tree.feature[node] == -1
            return
        f, cut = tree.feature[node], tree.cut[node]
        assert next(v for v, *at in found if at == [f, cut]) == pytest.approx(gain)
        check(tree.left[node], rows[bins[rows, f] <= cut], depth + 1)
        check(tree.right[node], rows[bins[rows, f] > cut], depth + 1)

    check(0, np.arange(n), 0)
    for wrong in (1, 257):
        with pytest.raises(ValueError):
            trees.gradient_boosting(df, ["a"], "y", "id", n_trees=1, n_bins=wrong)


def test_trees_learn_what_lines_cannot(xor):
    boosted = trees.gradient_boosting(xor, ["a", "b", "c"], "y", "id", n_trees=12, rate=0.5, depth=3, min_rows=20, colsample=1.0)
    assert accuracy(xor, boosted.probability()) > 0.9
    forest = trees.random_forest(xor, ["a", "b", "c"], "y", "id", n_trees=15, depth=6, min_rows=10, max_features=2)
    assert accuracy(xor, forest.probability()) > 0.9
    hybrid, margin = trees.logistic_boosting(xor, ["a", "b", "c"], "y", "id", n_trees=5, rate=0.5, min_rows=20, colsample=1.0)
    assert accuracy(xor, hybrid.probability(margin)) > 0.85


def test_no_split_gives_the_prevalence(xor):
    p = xor.agg(F.avg("y")).first()[0]
    for model in (trees.gradient_boosting(xor, ["a"], "y", "id", n_trees=0), trees.gradient_boosting(xor, ["a"], "y", "id", n_trees=1, depth=0, subsample=1.0), trees.random_forest(xor, ["a"], "y", "id", n_trees=2, depth=0, subsample=1.0)):
        assert xor.select(model.probability().alias("p")).agg(F.max("p"), F.min("p")).first() == pytest.approx((p, p))


@pytest.fixture(scope="module")
def public(spark):
    return spark.createDataFrame([(2.3, 3.2, 0), (1.0, 0.1, 1), (1.4, 2.3, 1)], "a double, b double, y int")


def test_logistic_descent(public):
    f = linear.Logistic(public, ["a", "b"], "y", 0.1)
    full, y = np.array([[1, 2.3, 3.2], [1, 1.0, 0.1], [1, 1.4, 2.3]]), np.array([0, 1, 1])
    w = np.zeros(3)
    for _ in range(2):
        w = w - 0.1 * (full.T @ (1 / (1 + np.exp(-full @ w)) - y) / 3 + 0.2 * w)
    got, loss = linear.logistic_descent(f, 2, 0.1)
    assert got == pytest.approx(w) and loss == pytest.approx(np.mean(np.logaddexp(0, full @ w) - y * (full @ w)))


def test_optimizers_reach_newtons_minimum(public):
    best = linear.newton_logistic(public, ["a", "b"], "y", 0.1, tolerance=1e-14)
    f = linear.Logistic(public, ["a", "b"], "y", 0.1)
    assert linear.adaptive_descent(f, 25)[0] == pytest.approx(best, abs=1e-4)
    w, _ = linear.extra_gradient(f, 25, radius=2.0)
    assert f(w)[0] - f(best)[0] < 0.05
    weighted = linear.Logistic(public, ["a", "b"], "y", 0.1, positive=2.0)
    assert weighted(best)[0] != pytest.approx(f(best)[0])


def test_descent_on_squares(public):
    w, loss = linear.gradient_descent(public, ["a", "b"], "y", 5, 0.05)
    x, y = np.array([[1, 2.3, 3.2], [1, 1.0, 0.1], [1, 1.4, 2.3]]), np.array([0, 1, 1])
    v = np.zeros(3)
    for _ in range(5):
        v = v - 0.05 * x.T @ (x @ v - y) / 3
    assert w == pytest.approx(v) and loss == pytest.approx(((x @ v - y) ** 2).mean() / 2)


def test_cross_validation(spark):
    df = spark.createDataFrame([(i, float(i % 10 == 0) + (i % 3) * 0.1, int(i % 10 == 0)) for i in range(200)], "id int, s double, y int")
    per, held = validation.cross_validate(df, "y", "id", lambda train: F.col("s"), 4)
    assert [r.f1 for r in per.collect()] == [1.0] * 4 and held.count() == 200
    assert validation.param_grid(a=[1, 2], b=[3]) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    assert validation.blend(df.withColumn("r", F.lit(0.0)), "s", "r", "y", 2) == (0.5, 0.5, 1.0)


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1), (1.0, None, 0), (None, 3.0, 1), (None, 3.0, 1)], "a double, b double, y int")
    got = {r.column: r for r in profiles.constancy(profiles.column_profile(statistics.value_histogram(df, ["a", "b"]))).collect()}
    assert got["a"].top_value is None and got["a"].status == "one value" and got["b"].top_value == 3.0 and got["b"].missing == 0.25
    assert [(r.column, r.value, r.n) for r in profiles.leakage(df, ["a"], F.col("y") == 1, 0.9, 2).collect()] == [("a", None, 2)]
    codes = spark.createDataFrame([(i, i // 2) for i in range(4)], "a int, b int")
    assert profiles.determination(codes, "a", "b").first() == pytest.approx((1.0, 0.5))
    rule = spark.createDataFrame([(i % 2, int(i % 2 == 1 and i < 80)) for i in range(100)], "g int, y int")
    assert profiles.best_rule_f1(rule, "g", F.col("y") == 1).first()[0] == pytest.approx(80 / 90)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    wide = spark.createDataFrame([(float(a), float(b) if i > 19 else None, 2 * float(a) + 1, 5.0) for i, (a, b) in enumerate(x)], "a double, b double, c double, d double")
    r, n = profiles.pairwise_correlation(wide, ["a", "b", "c", "d"])
    assert r[0, 2] == pytest.approx(1) and n[0, 1] == 180 and r[0, 1] == pytest.approx(np.corrcoef(x[20:].T)[0, 1]) and np.isnan(r[0, 3])


def test_survey_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Id,_STATE,_BMI5\n10,1,2500\n11,1,\n12,9,3000\n")
    (tmp_path / "y.csv").write_text("Id,L\n10,-1\n11,1\n12,-1\n")
    (tmp_path / "z.csv").write_text("Id,L\n10,-1\n11,1\n13,-1\n")
    got = survey.read_labelled(spark, f"{tmp_path}/x.csv", f"{tmp_path}/y.csv", ["_STATE", "_BMI5"], "L").orderBy("Id")
    assert [tuple(r) for r in got.collect()][1] == (11, 1.0, None, 1)
    with pytest.raises(ValueError):
        survey.read_labelled(spark, f"{tmp_path}/x.csv", f"{tmp_path}/z.csv", ["_STATE", "_BMI5"], "L")
    assert survey.cached(spark, f"{tmp_path}/c", lambda: got).count() == survey.cached(spark, f"{tmp_path}/c", None).count() == 3
    out = got.select("Id", F.col("L").alias("Prediction"))
    survey.write_submission(out, f"{tmp_path}/s")
    assert survey.check_submission(spark, f"{tmp_path}/s", got) and not survey.check_submission(spark, f"{tmp_path}/s", got.where("Id > 10"))
    with pytest.raises(ValueError):
        survey.write_submission(out.withColumn("Prediction", F.lit(0)), f"{tmp_path}/t")
    assert [r.id for r in survey.every_nth(spark.range(205), "id").orderBy("id").collect()] == [0, 50, 100, 150, 200]


def jobs_of(spark, made):
    """What ``made`` gives, and how many jobs it ran."""
    group = f"count {id(made)}"
    spark.sparkContext.setJobGroup(group, group)
    got = made()
    spark.sparkContext.setJobGroup("rest", "rest")
    return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("colsample", [0.5, 1.0])
def test_a_tree_of_few_columns_is_one_job(spark, monkeypatch, colsample):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 3)).round(1)
    y = (rng.random(900) < 1 / (1 + np.exp(-x[:, 0] * x[:, 1]))).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y int").persist()
    grown = lambda: trees.gradient_boosting(df, ["a", "b", "c"], "y", "id", n_trees=11, depth=4, min_rows=20, n_bins=16, colsample=colsample)
    once, few = jobs_of(spark, grown)
    monkeypatch.setattr(trees, "CUBE", 0)
    by_level, many = jobs_of(spark, grown)
    df.unpersist()
    assert few < 40 and many > few + 11
    for a, b in zip(once.trees, by_level.trees, strict=True):
        assert (a.feature, a.cut, a.left, a.right) == (b.feature, b.cut, b.left, b.right) and a.value == pytest.approx(b.value, abs=1e-12)


@pytest.mark.parametrize("name", ["boosted_trees", "forest", "hybrid_trees", "ridge_cv"])
def test_queries_of_models(spark, name):
    got = plans.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) and not got.isna().any().any()
    assert name == "ridge_cv" or len(got) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
