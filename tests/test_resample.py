from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import scrubwell as sw
from helpers import rows


@pytest.fixture(scope="module")
def skewed_classes(spark):
    """90 / 8 / 2 and a NULL class; half of the largest class are copies of one row."""
    data = [("big", i if i < 45 else -1) for i in range(90)]
    data += [("mid", i) for i in range(8)] + [("small", i) for i in range(2)] + [(None, i) for i in range(5)]
    return spark.createDataFrame(data, "y string, x int")


def sizes(df):
    return Counter(r["y"] for r in df.collect())


@pytest.mark.parametrize("piece", [1 << 20, 3])
def test_oversample(skewed_classes, piece):
    result = sw.oversample(skewed_classes, "y", piece=piece)
    assert sizes(result) == {"big": 90, "mid": 90, "small": 90, None: 90}
    before, after = Counter(map(tuple, skewed_classes.collect())), Counter(map(tuple, result.collect()))
    assert not before - after and set(after) == set(before)
    assert result.columns == skewed_classes.columns
    mid = sorted(n for (y, _), n in after.items() if y == "mid")
    assert mid[0] != mid[-1]  # draws, not equal shares


@pytest.mark.parametrize("piece", [1 << 20, 3])
def test_undersample(skewed_classes, piece):
    result = sw.undersample(skewed_classes, "y", piece=piece)
    assert sizes(result) == {"big": 2, "mid": 2, "small": 2, None: 2}
    assert not Counter(map(tuple, result.collect())) - Counter(map(tuple, skewed_classes.collect()))


def test_copies_of_one_row_are_divided(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", i) for i in range(20)], "y string, x int")
    assert rows(sw.undersample(df, "y", piece=4)).count(("a", 1)) == 20


def test_key(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b", "text") for i in range(40)], "id int, y string, t string")
    assert sizes(sw.undersample(df, "y", key=["id"])) == {"a": 10, "b": 10}
    with pytest.raises(ValueError, match="does not identify"):
        sw.undersample(df, "y", key=["t"])


def test_does_not_depend_on_partitioning(skewed_classes):
    for method in ("over", "under"):
        assert rows(sw.resample(skewed_classes, "y", method)) == rows(
            sw.resample(skewed_classes.repartition(7), "y", method)
        )
    assert rows(sw.undersample(skewed_classes, "y", seed=1)) != rows(sw.undersample(skewed_classes, "y", seed=2))
    with pytest.raises(ValueError):
        sw.resample(skewed_classes, "y", "both")


def test_cells_do_not_run_into_each_other(spark):
    df = spark.createDataFrame([("a|b", "c", 0), ("a", "b|c", 0), ("a", None, 1), ("aN", "", 1), ("z", "z", 1)], "p string, q string, y int")
    assert sorted(r["y"] for r in sw.undersample(df, "y").collect()) == [0, 0, 1, 1]
    assert sorted(r["y"] for r in sw.oversample(df, "y").collect()) == [0, 0, 0, 1, 1, 1]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([0, 1, None]), st.integers(0, 2)), min_size=1, max_size=30))
def test_any_classes(spark, data):
    df = spark.createDataFrame(data, "y int, x int")
    counts = sizes(df)
    assert set(sizes(sw.oversample(df, "y", piece=2)).values()) == {max(counts.values())}
    assert set(sizes(sw.undersample(df, "y", piece=2)).values()) == {min(counts.values())}


def test_split(spark):
    df = spark.range(2000).selectExpr("id", "id % 7 AS k")
    train, test = sw.train_test_split(df)
    assert train.count() + test.count() == 2000 and 1500 < train.count() < 1700
    assert train.intersect(test).count() == 0
    again, _ = sw.train_test_split(df.repartition(5))
    assert rows(again) == rows(train)
    copies, _ = sw.train_test_split(df.select("k"))
    assert copies.select("k").distinct().count() * 2000 // 7 == pytest.approx(copies.count(), abs=7)
