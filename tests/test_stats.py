import numpy as np
import pytest

from helixframe.operators import stats as T


@pytest.mark.parametrize("kind", ["uniform", "ties", "tails", "long"])
def test_ranks_are_those_of_the_order(spark, monkeypatch, kind):
    monkeypatch.setattr(T, "LAST", 20)
    monkeypatch.setattr(T, "PARTS", 7)
    rng = np.random.default_rng(4)
    x = {"uniform": rng.random(900), "ties": rng.integers(0, 4, 900).astype(float), "tails": np.exp(rng.normal(size=900) * 9), "long": rng.integers(2**60, 2**60 + 500, 900)}[kind]
    values = spark.createDataFrame([(None,), *((v,) for v in x.tolist())], "x bigint" if kind == "long" else "x double").repartition(5)
    ranks = [0, 1, 449, 450, 899]
    assert T.at_ranks(values, "x", ranks) == [sorted(x.tolist())[r] for r in ranks]
    assert T.at_ranks(values, "x", [900, -1]) == [None, None]
    if kind != "long":
        r = T.distribution(values, "x").head()
        assert (r["n"], r["median"]) == (900, pytest.approx(np.median(x)))


def test_ranks_of_odd_values(spark):
    values = spark.createDataFrame([(v,) for v in (3.0, float("inf"), 1.0, float("-inf"), float("nan"))], "x double")
    assert T.at_ranks(values, "x", [0, 1, 2, 3]) == [float("-inf"), 1.0, 3.0, float("inf")]
    assert T.at_ranks(values.limit(0), "x", [0]) == [None]
