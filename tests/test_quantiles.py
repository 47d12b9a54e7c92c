import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from scrubwell.functions.quantiles import quantiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 1.0]


def check(spark, values, **limits):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    found = quantiles(df, ["v"], PROBS, mode="exact", **limits)["v"]
    assert found == pytest.approx(list(np.quantile(values, PROBS)))


@pytest.mark.parametrize("limits", [{}, {"direct_limit": 10, "sort_limit": 3}, {"direct_limit": 10, "sort_limit": 500}])
def test_exact_on_spread_and_heavy_values(spark, limits):
    rng = np.random.default_rng(1)
    check(spark, [float(v) for v in rng.lognormal(2, 3, 1500)], **limits)
    check(spark, [7.0] * 700 + [8.0] * 700 + [float(v) for v in range(20)], **limits)
    check(spark, [3.0] * 300, **limits)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5).map(float), min_size=1, max_size=60))
def test_selection_equals_sorting(spark, values):
    check(spark, values, direct_limit=2, sort_limit=1)


def test_null_nan_and_arguments(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None), (None, None)], "v double, e double")
    assert quantiles(df, ["v", "e"], [0.5], mode="exact") == {"v": [2.0], "e": None}
    assert quantiles(df, ["v", "e"], [0.5], error=0.001) == {"v": [1.0], "e": None}
    assert quantiles(df, [], [0.5]) == {}
    with pytest.raises(ValueError):
        quantiles(df, ["v"], [0.5], mode="fast")
    with pytest.raises(ValueError):
        quantiles(df, ["v"], [0.5], error=0)
