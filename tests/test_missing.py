import pytest

import scrubwell as sw
from helpers import by, rows


def test_counts_null_and_empty_string_but_not_nan(nulls):
    counts = {c: r["missing_count"] for c, r in by(sw.missing_counts(nulls)).items()}
    assert counts == {
        "i": 1, "l": 1, "d": 1, "dec": 1, "s": 2, "b": 1, "dt": 1, "ts": 1, "tn": 1, "none": 4, "one": 0, "y": 1,
    }
    assert [r["missing_count"] for r in sw.missing_counts(nulls).collect()][:2] == [4, 2]


def test_rows_and_columns(nulls):
    part = nulls.select("i", "s", "one")
    assert sw.missing_rows(part).count() == 2
    assert {c: r["is_numeric"] for c, r in by(sw.missing_columns(part)).items()} == {"i": True, "s": False}
    assert sw.offered_strategies(part) == ["none", "drop", "mean", "median", "zero", "unknown"]
    assert sw.offered_strategies(nulls.select("s", "one")) == ["none", "drop"]


def test_drop_removes_null_and_nan_keeps_empty(nulls):
    assert rows(sw.handle_missing(nulls.select("i", "d"), "drop")) == [(1, 1.5), (5, 4.0)]
    assert sw.handle_missing(nulls.select("s"), "drop").count() == 3
    assert sw.handle_missing(nulls.select("s"), "drop", empty_is_missing=True).count() == 2


def test_mean_cuts_whole_numbers_and_skips_empty_columns(nulls):
    filled = sw.handle_missing(nulls.select("i", "l", "d", "none"), "mean")
    assert [f.dataType.simpleString() for f in filled.schema] == ["int", "bigint", "double", "int"]
    # i: (1+2+5)/3 = 2.67 -> 2; d: (1.5+4)/2, also in place of NaN
    assert rows(filled) == [(1, 10, 1.5, None), (2, 26, 2.75, None), (2, 30, 2.75, None), (5, 40, 4.0, None)]


def test_median_zero_unknown_none(nulls):
    exact = sw.handle_missing(nulls.select("i", "l"), "median", mode="exact")
    assert rows(exact) == [(1, 10), (2, 30), (2, 30), (5, 40)]
    assert rows(sw.handle_missing(nulls.select("i", "d", "s"), "zero")) == [
        (0, 0.0, None), (1, 1.5, "a"), (2, 0.0, ""), (5, 4.0, "a"),
    ]
    assert rows(sw.handle_missing(nulls.select("i", "s"), "unknown")) == [
        (None, "Unknown"), (1, "a"), (2, ""), (5, "a"),
    ]
    assert sw.handle_missing(nulls, "none") is nulls
    with pytest.raises(ValueError, match="unknown strategy"):
        sw.handle_missing(nulls, "guess")


def test_decimal_is_filled_as_decimal(nulls):
    filled = sw.handle_missing(nulls.select("dec"), "zero")
    assert filled.schema["dec"].dataType.simpleString() == "decimal(10,2)"
    assert sorted(float(r[0]) for r in filled.collect()) == [0.0, 1.0, 2.0, 4.0]


def test_awkward_names(spark):
    df = spark.createDataFrame([(1, None, "", 2.0), (None, 3, "t", None)], "count int, `my col` int, `a.b` string, `x``y` double")
    assert {c: r["missing_count"] for c, r in by(sw.missing_counts(df)).items()} == {"count": 1, "my col": 1, "a.b": 1, "x`y": 1}
    assert sw.handle_missing(df, "zero").filter("`my col` = 0 OR count = 0").count() == 2
    assert sw.handle_missing(df, "unknown").columns == df.columns


def test_reserved_names_are_refused(spark):
    with pytest.raises(ValueError, match="reserved"):
        sw.missing_counts(spark.range(1).withColumnRenamed("id", "__x"))
