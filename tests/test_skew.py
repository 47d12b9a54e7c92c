import math

import pytest

import scrubwell as sw
from helpers import by, rows


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.createDataFrame(
        [(1.0, -8.0, 5, "a", 0.1), (2.0, 1.0, 5, "a", 0.2), (3.0, 1.0, 5, "b", 0.3), (100.0, 1.0, 5, None, 0.4)],
        "v double, neg double, one int, s string, y double",
    )


def population_skewness(values):
    mean = sum(values) / len(values)
    second = sum((v - mean) ** 2 for v in values) / len(values)
    return sum((v - mean) ** 3 for v in values) / len(values) / second ** 1.5


def test_report(skewed):
    found = by(sw.skewness_report(skewed, "y"))
    assert list(found) == ["neg", "one", "s", "v"]
    assert found["v"]["skewness"] == round(population_skewness([1, 2, 3, 100]), 3)
    assert found["one"]["skewness"] is None
    # a 1/2, b 1/4, NULL 1/4
    assert found["s"] == {"column": "s", "type": "Categorical", "skewness": None, "entropy": 1.5}


def test_long_texts_keep_their_groups(spark):
    df = spark.createDataFrame([("x" * 100,), ("x" * 100,), ("x" * 101,), ("#" + "x",)], "s string")
    assert by(sw.categorical_entropy(df))["s"]["entropy"] == 1.5


def test_empty_tables_and_single_types(spark, skewed):
    empty = skewed.limit(0)
    assert by(sw.skewness_report(empty))["s"]["entropy"] == 0.0
    assert rows(sw.skewness_report(skewed.select("y"), "y")) == []
    assert rows(sw.numeric_skewness(skewed.select("s"))) == []
    assert by(sw.skewness_report(skewed.select("s")))["s"]["type"] == "Categorical"


def test_high_skew_includes_the_target(skewed):
    assert [r["column"] for r in sw.high_skew_columns(skewed).collect()] == ["neg", "v"]
    fixed, names = sw.fix_skew(skewed, "log", target="v", include_target=False)
    assert names == ["neg"]
    fixed, names = sw.fix_skew(skewed, "log", target="v")
    assert names == ["v", "neg"]
    values = {r["v"]: r["neg"] for r in fixed.collect()}
    assert math.isclose(max(values), math.log1p(100.0))
    assert None in values.values()  # log(1 - 8)


def test_roots(skewed):
    root = [r["neg"] for r in sw.fix_skew(skewed, "sqrt")[0].collect()]
    assert any(math.isnan(v) for v in root)
    cube = sorted(r["neg"] for r in sw.fix_skew(skewed, "cbrt")[0].collect())
    assert math.isclose(cube[0], -2.0)
    with pytest.raises(ValueError, match="log, sqrt, cbrt"):
        sw.fix_skew(skewed, "square")
    same, names = sw.fix_skew(skewed.select("one"))
    assert names == [] and same.columns == ["one"]


def test_decimals_and_odd_names(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (50,)], "`my col` int").selectExpr("cast(`my col` AS decimal(10,2)) AS `my col`")
    fixed, names = sw.fix_skew(df)
    assert names == ["my col"] and fixed.schema["my col"].dataType.simpleString() == "double"
