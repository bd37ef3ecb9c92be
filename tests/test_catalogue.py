import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import catalogue, linear, matrices, minibatch, statistics

Rules = catalogue.Catalogue


def rows(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_codes_have_a_default_and_conversions_read_cleaned_codes(spark):
    raw = [(1, 107.0, 7.0, 82014.0, 2015.0, 3.0, 40.0), (2, 888.0, 3.0, 772014.0, 2015.0, 3.0, 50.0), (3, 555.0, 9.0, 801.0, 2015.0, 3.0, None), (4, None, None, 122016.0, 2015.0, 3.0, 20.0), (5, 520.0, 8.0, None, None, 3.0, 20.0)]
    df = spark.createDataFrame(raw, "id int, a double, b double, d double, y double, m double, age double")
    own = Rules(codes={"a": ((777,), (888,)), "d": ((), ()), "y": ((), ()), "m": ((), ()), "age": ((), ())}, conversions={"a": catalogue.Conversion("rate", ("age",), 555.0), "d": catalogue.Conversion("months", ("y", "m"))})
    got = rows(catalogue.clean(df, own, "id"))
    assert [got[i].a for i in range(1, 6)] == [7 * 365.0, 0.0, None, None, 520.0]  # 555 stands for a value that is missing here
    assert [got[i].b for i in range(1, 6)] == [None, 3.0, None, None, 8.0]
    assert [got[i].d for i in range(1, 6)] == [7.0, 12 * 2015 + 3 - (12 * 2014 + 6.5), None, 0.0, None]
    with pytest.raises(KeyError):
        catalogue.clean(df.drop("age"), own, "id")
    assert catalogue.clean(df.drop("a", "d"), own, "id").columns == ["id", "b", "y", "m", "age"]
    with pytest.raises(ValueError):
        catalogue.clean(df, Rules(conversions={"b": catalogue.Conversion("nope")}), "id")


def sequential(values, gates):
    """Brute force: gate after gate, row by row."""
    out = dict(values)
    for gate, fills in gates:
        if all(c in out for c in gate) and all(out[c] in answers for c, answers in gate.items()):
            out.update({c: v for c, v in fills.items() if c in out and out[c] is None})
    return out


def test_gates_follow_each_other(spark):
    rng = np.random.default_rng(3)
    names = list("abcdef")
    for _ in range(6):
        gates = [({str(c): [0, 1] if rng.random() < 0.5 else [2] for c in rng.choice(names, rng.integers(1, 3), replace=False)}, {str(c): float(rng.integers(0, 3)) for c in rng.choice([*names, "zz"], 2, replace=False)}) for _ in range(7)]
        gates.append(({"zz": [1]}, {"a": 9.0}))
        data = [[None if rng.random() < 0.5 else float(rng.integers(0, 3)) for _ in names] for _ in range(60)]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, " + ", ".join(f"{c} double" for c in names))
        got = rows(catalogue.fill_gates(df, Rules(gates=gates)))
        for i, r in enumerate(data):
            assert {c: got[i][c] for c in names} == sequential(dict(zip(names, r, strict=True)), gates)


def test_the_plan_grows_with_the_rules(spark):
    df = spark.range(5).select("id", *(F.lit(None).cast("double").alias(f"c{k}") for k in range(41)))
    size = lambda n: len(catalogue.fill_gates(df, Rules(gates=[({f"c{k}": [1]}, {f"c{k + 1}": 1.0}) for k in range(n)]))._jdf.queryExecution().optimizedPlan().toString())
    assert size(40) < 3 * size(20)


def test_candidates_and_selection_rules():
    own = Rules(left_out={"domain": ["a", "x"], "redundant": ["b"], "converted": ["c"], "leakage": ["x"], "R1": ["d"], "R2": ["e"]})
    names = ["a", "b", "c", "d", "e", "f", "x"]
    assert own.candidates(names) == ["d", "e", "f"] and own.candidates(names, select=True) == ["f"] and own.candidates(names, select=["R2"]) == ["d", "f"]
    assert own.candidates(names, domain=False, redundant=False, convert=False) == ["a", "b", "c", "d", "e", "f"]
    assert own.candidates(names, keep_leakage=True) == ["d", "e", "f", "x"] and own.not_selected(True) == ["d", "e"]
    with pytest.raises(ValueError):
        own.not_selected(["R9"])


def test_a_catalogue_is_read_from_json(spark):
    text = json.dumps({"codes": {"a": [[7], [8]]}, "gates": [[{"a": [1]}, {"b": 0}]], "conversions": {"b": {"kind": "recode", "values": [[8, 5]]}}, "bins": {"b": [1, 3]}})
    got = rows(catalogue.clean(spark.createDataFrame([(1, 1.0, None), (2, 8.0, 8.0), (3, 7.0, 2.0)], "id int, a double, b double"), Rules.read(text), "id"))
    assert [tuple(got[i])[1:] for i in (1, 2, 3)] == [(1.0, 0.0), (0.0, 2.0), (None, 1.0)]
    with pytest.raises(ValueError):
        Rules.read('{"gate": []}')


def test_missing_masks_against_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.random((400, 4)) < 0.4
    masks = np.column_stack([base[:, 0], base[:, 1], ~base[:, 0], base[:, 1] ^ (rng.random(400) < 0.01), base[:, 2], np.zeros(400, bool), np.ones(400, bool), base[:, 3]])
    names = [f"m{k}" for k in range(8)]
    df = spark.createDataFrame([tuple(None if v else 1 for v in r) for r in masks.tolist()], ", ".join(f"{c} int" for c in names)).repartition(5)
    n, both = matrices.co_missing(df, names)
    assert n == 400 and (both == masks.T.astype(int) @ masks.astype(int)).all()
    assert {tuple(r) for r in matrices.missing_together(df, names).collect()} == {("m1", "m1"), ("m3", "m1")}
    assert statistics.one_per_group(df, names) == ["m0", "m1", "m4", "m5", "m6", "m7"]
    empty = df.limit(0)
    assert matrices.co_missing(empty, names)[0] == 0 and matrices.missing_together(empty, names).count() == 0 and statistics.one_per_group(empty, names) == names


def test_masks_of_a_wide_table(spark):
    names = [f"c{k}" for k in range(321)]
    df = spark.range(20_000).select(*(F.when(F.col("id") % (k % 37 + 2) > 0, 1).alias(c) for k, c in enumerate(names)))
    assert statistics.one_per_group(df, names) == names[:37]


def bits(counts):
    p = np.array(counts)[np.array(counts) > 0] / max(1, sum(counts))
    return float(-(p * np.log2(p)).sum())


def test_determination_and_redundancy_of_forty_columns(spark):
    rng = np.random.default_rng(5)
    d, levels = 40, [int(v) for v in rng.integers(1, 7, 40)]
    codes = np.column_stack([rng.integers(0, n, 500) for n in levels]).astype(object)
    levels[1], levels[2] = levels[0], 3
    codes[:, 1] = [levels[0] - 1 - v for v in codes[:, 0]]
    codes[:, 2] = [v % 3 for v in codes[:, 0]]
    codes[rng.random((500, d)) < 0.1] = None
    codes[:, 3] = None
    names = [f"c{k}" for k in range(d)]
    df = spark.createDataFrame([tuple(None if v is None else int(v) for v in r) for r in codes], ", ".join(f"{c} int" for c in names)).repartition(4)
    got = {(r.a, r.b): r for r in matrices.determinations(df, names, levels).collect()}
    assert len(got) == d * (d - 1) // 2
    for a in range(d):
        for b in range(a + 1, d):
            own = [(x, y) for x, y in zip(codes[:, a], codes[:, b], strict=True) if x is not None and y is not None]
            r, count = got[names[a], names[b]], lambda v: list(np.unique(np.array(v), return_counts=True, axis=0)[1]) if v else []
            ha, hb, hab = bits(count([x for x, _ in own])), bits(count([y for _, y in own])), bits(count(own))
            assert r.n == len(own)
            for value, h in ((r.forward, hb), (r.backward, ha)):
                assert value is None if len(own) < 30 or h == 0 else value == pytest.approx((ha + hb - hab) / h, abs=1e-9)
    share = {c: float(np.mean([v is None for v in codes[:, k]])) for k, c in enumerate(names)}
    dropped = matrices.redundant(matrices.determinations(df, names, levels), names, share, set(names), tolerance=0.1)
    assert dropped["c1"] == "c0" and dropped["c2"] == "c0" and "c3" not in dropped and "c0" not in dropped
    assert "c1" not in matrices.redundant(matrices.determinations(df, names, levels), names, share, set(), tolerance=0.1)
    with pytest.raises(ValueError):
        matrices.contingencies(df, names[:2], [10**5, 10**5])


@pytest.fixture(scope="module")
def drawn(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, y int").repartition(3)


def on_driver(df, n, steps, batch, seed):
    table = {r["rank"]: (np.array(r.x), r.y) for r in minibatch.ranked(df, ["a", "b"], "y", "id")[0].collect()}
    assert sorted(table) == list(range(n))
    found = {(r.step, r.place): table[r["rank"]] for r in minibatch.draws(df, n, 0, steps, batch, seed).collect()}
    return table, [[found[t, p] for p in range(batch)] for t in range(steps)]


def test_descent_by_rows_equals_numpy_on_the_same_draws(drawn):
    w, loss = minibatch.descent_by_rows(drawn, ["a", "b"], "y", "id", 0.05, 700, seed=3)
    table, steps = on_driver(drawn, 500, 700, 1, 3)
    v = np.zeros(3)
    for ((x, y),) in steps:
        v = v + 0.05 * x * (y - x @ v)
    assert np.allclose(w, v) and loss == pytest.approx(np.mean([(y - x @ v) ** 2 for x, y in table.values()]) / 2)
    assert minibatch.descent_by_rows(drawn.limit(0), ["a", "b"], "y", "id")[0].tolist() == [0, 0, 0]


@pytest.mark.parametrize("batch", [64, 500])
def test_clipped_newton_equals_numpy_on_the_same_draws(drawn, batch):
    w, loss = minibatch.clipped_newton(drawn, ["a", "b"], "y", "id", 0.01, 0.05, 23, batch, seed=4, chunk=10)
    table, steps = on_driver(drawn, 500, 23, batch, 4)
    if batch == 500:
        steps = [list(table.values())] * 23
    v, m, h = np.zeros(3), np.zeros(3), np.zeros(3)
    for t, own in enumerate(steps):
        x, y = np.stack([r[0] for r in own]), np.array([r[1] for r in own])
        p = 1 / (1 + np.exp(-x @ v))
        m = 0.965 * m + 0.035 * ((x * (p - y)[:, None]).mean(0) + 0.02 * v)
        if t in (0, 10, 20):
            h = 0.99 * h + 0.01 * ((x * x * (p * (1 - p))[:, None]).mean(0) + 0.02)
        v = v - 0.05 * np.clip(m / np.maximum(0.05 * h, 1e-12), -1, 1)
    x, y = np.stack([r[0] for r in table.values()]), np.array([r[1] for r in table.values()])
    assert np.allclose(w, v) and loss == pytest.approx(np.mean(np.log1p(np.exp(x @ v)) - y * (x @ v)))


def test_missing_features_are_an_error(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (2, None, 0)], "id int, a double, y int")
    for call in (lambda: linear.gram(df, ["a"], "y"), lambda: linear.newton_logistic(df, ["a"], "y"), lambda: minibatch.clipped_newton(df, ["a"], "y", "id", steps=1)):
        with pytest.raises(Exception, match="is missing"):
            call()


def test_newton_reaches_a_stationary_point(drawn):
    w = linear.newton_logistic(drawn, ["a", "b"], "y", 0.01)
    data = np.array([[1.0, r.a, r.b, r.y] for r in drawn.collect()])
    x, y = data[:, :3], data[:, 3]
    slope = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + 0.02 * w
    assert np.abs(slope).max() < 1e-5
