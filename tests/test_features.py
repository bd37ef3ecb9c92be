import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import features, linear

ROWS = [(i, float(i % 7) if i % 5 else None, float(1 + i % 2), float(i % 3), float(i * i % 97), int(i % 3 == 0)) for i in range(400)]
TYPES = {"a": "continuous", "b": "binary", "c": "nominal", "d": "count"}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, a double, b double, c double, d double, y int").coalesce(1).cache()


def test_pipeline(table):
    fitted = features.fit(table, TYPES, F.col("y") == 1, min_rows=10, min_difference=0.0, one_hot=["c"], curves=["sqrt"], degree=2, top=2, pairs=[("a", "d")])
    assert fitted.recoded == ["b"] and fitted.categories == {"c": [1.0, 2.0]}  # 0 is the most frequent
    got = fitted.transform(table, "id", "y").orderBy("id").toPandas()
    assert list(got.columns) == ["id", "y", *fitted.names]
    a = np.array([np.nan if r[1] is None else r[1] for r in ROWS])
    a = np.where(np.isnan(a), np.nanmedian(a), a)
    z = (a - a.mean()) / a.std()
    assert np.allclose(got["a"], z)
    assert np.allclose(got["a^2"], (z**2 - (z**2).mean()) / (z**2).std())
    assert "b^2" not in got and np.allclose(got[fitted.base].mean(), 0) and np.allclose(got[fitted.expanded].std(ddof=0), 1)
    with pytest.raises(ValueError):
        features.fit(table, TYPES, F.col("y") == 1, pairs=[("a", "nope")])


def test_score_test(table):
    w = linear.newton_logistic(table, ["d"], "y", 0.0)
    strong, weak = linear.score_test(table, ["d"], ["c"], "y", w), linear.score_test(table, ["d"], ["b"], "y", w)
    assert strong[0] > 50 and strong[1] < 1e-6 and weak[1] > 0.01
