import numpy as np
import pytest

from loomwork.sources import results


def test_nested_results_are_written_whole_and_replaced(spark, tmp_path):
    path = f"{tmp_path}/out/best.json"
    one = {"f1": np.float64(0.5), "folds": np.array([0.25, 0.75]), "pipeline": {"degree": np.int64(2), "names": ["a", "é"], "none": None, "on": True}}
    want = {"f1": 0.5, "folds": [0.25, 0.75], "pipeline": {"degree": 2, "names": ["a", "é"], "none": None, "on": True}}
    results.save_result(spark, path, one)
    assert results.load_result(spark, path) == want
    results.save_result(spark, path, {"f1": 1})
    assert results.load_result(spark, path) == {"f1": 1} and [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["best.json"]
    with pytest.raises(TypeError):
        results.save_result(spark, path, {"f1": object()})
    assert results.load_result(spark, path) == {"f1": 1}


def test_scores_are_built_anew_only_when_settings_or_inputs_change(spark, tmp_path):
    source, root, built = f"{tmp_path}/in", f"{tmp_path}/scores", []
    spark.range(5).write.parquet(source)

    def scores(**settings):
        def build():
            built.append(settings)
            return spark.read.parquet(source).selectExpr("id", f"id * {settings['rate']} AS score")

        return sorted(tuple(r) for r in results.scored(spark, root, settings, [source], build).collect())

    first = scores(rate=2, names=["a", "b"])
    assert first == [(i, 2 * i) for i in range(5)] == scores(names=["a", "b"], rate=2) and len(built) == 1
    assert scores(rate=3, names=["a", "b"])[4] == (4, 12) and len(built) == 2
    spark.range(5, 6).write.mode("append").parquet(source)
    assert len(scores(rate=2, names=["a", "b"])) == 6 and len(built) == 3

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        results.scored(spark, root, {"rate": 9}, [source], broken)
    assert len(scores(rate=9)) == 6 and not [p for p in (tmp_path / "scores").iterdir() if p.name.startswith(".part")]
