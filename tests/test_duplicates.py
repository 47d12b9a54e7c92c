import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import scrubwell as sw
from helpers import rows
from scrubwell.operators import duplicates

DATA = [("a", 1, "x"), ("a", 1, "x"), ("a", 1, "y"), ("b", 2, "x"), (None, 3, "x"), (None, 3, "z"), ("c", None, "x")]


@pytest.fixture(scope="module")
def dups(spark):
    return spark.createDataFrame(DATA, "s string, n int, y string")


def test_groups_leave_the_target_out(dups):
    assert rows(sw.duplicate_groups(dups, "y")) == [(None, 3, 2), ("a", 1, 3)]
    assert rows(sw.duplicate_groups(dups, "y", with_count=False)) == [(None, 3), ("a", 1)]
    assert rows(sw.duplicate_groups(dups)) == [("a", 1, "x", 2)]
    assert rows(sw.duplicate_groups(dups, columns=["n"])) == [(1, 3), (3, 2)]


def test_drop_compares_all_columns_and_puts_the_target_last(dups):
    cleaned = sw.drop_duplicates(dups, "s")
    assert cleaned.columns == ["n", "y", "s"]
    assert cleaned.count() == 6
    assert rows(sw.drop_duplicates(sw.drop_duplicates(dups))) == rows(sw.drop_duplicates(dups))


def test_same_without_the_hash_pass(dups, monkeypatch):
    expected = rows(sw.drop_duplicates(dups)), rows(sw.duplicate_groups(dups, "y"))
    monkeypatch.setattr(duplicates, "_worth_hashing", lambda df, names: False)
    assert (rows(sw.drop_duplicates(dups)), rows(sw.duplicate_groups(dups, "y"))) == expected
    monkeypatch.setattr(duplicates, "_worth_hashing", lambda df, names: True)
    monkeypatch.setattr(duplicates, "repeated_keys", lambda df, names: None)
    assert (rows(sw.drop_duplicates(dups)), rows(sw.duplicate_groups(dups, "y"))) == expected


def test_column_called_count(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "count int, y string")
    assert rows(sw.duplicate_groups(df, "y")) == [(1, 2)]


def test_negative_zero_and_nan_are_equal(spark):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, "a"), (float("nan"), "a"), (float("nan"), "a")], "d double, s string")
    assert sw.drop_duplicates(df).count() == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "", None]), st.integers(0, 2)), min_size=1, max_size=30))
def test_any_rows(spark, data):
    df = spark.createDataFrame(data, "s string, n int")
    assert rows(sw.drop_duplicates(df.repartition(3))) == rows(df.distinct())


def test_maps_are_equal_in_any_order(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1, map('a', 1, 'b', 2), array(map('x', 0.0D))), (1, map('b', 2, 'a', 1), array(map('x', -0.0D))), (1, map('a', 1), NULL),
        (1, NULL, NULL), (1, NULL, NULL), (2, map('a', 1, 'b', CAST(NULL AS INT)), array()) AS t(i, m, l)"""
    ).selectExpr("i", "m", "l", "named_struct('deep', m) AS s")
    assert sw.drop_duplicates(df).count() == 4 and sw.drop_duplicates(df).schema.simpleString() == df.schema.simpleString()
    groups = {str(r["m"]): r["n_rows"] for r in sw.duplicate_groups(df).collect()}
    assert groups in ({"{'a': 1, 'b': 2}": 2, "None": 2}, {"{'b': 2, 'a': 1}": 2, "None": 2})
    train, test = sw.train_test_split(df)
    assert train.count() + test.count() == 6 and min(train.filter("m['b'] = 2").count(), test.filter("m['b'] = 2").count()) == 0
    assert sw.undersample(df, "i").count() == 2 and sw.oversample(df, "i").count() == 10
