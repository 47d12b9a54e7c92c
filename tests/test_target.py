import numpy as np
import pytest

import scrubwell as sw
from helpers import by, rows
from scrubwell.functions.indexing import frequency_index


@pytest.fixture(scope="module")
def classes(spark):
    data = [("b", 1.0)] * 3 + [("a", 2.0)] * 3 + [("c", 3.0)] * 5 + [("d", 4.0)] + [(None, 9.0)] * 2
    return spark.createDataFrame(data, "y string, x double")


@pytest.mark.parametrize("small_limit", [100, 2])
def test_index_by_frequency_then_name(classes, small_limit):
    indexed = sw.index_target(classes, "y", small_limit)
    assert indexed.columns == ["x", "y"]
    assert set(rows(indexed)) == {(3.0, 0.0), (2.0, 1.0), (1.0, 2.0), (4.0, 3.0)}
    assert indexed.count() == 12


def test_many_values_are_numbered_alike(spark):
    data = [("v%03d" % (i % 100),) for i in range(260)] + [("hot",)] * 300
    df = spark.createDataFrame(data, "s string")
    small, large = frequency_index(df, "s"), frequency_index(df, "s", small_limit=10)
    assert rows(small.table) == rows(large.table)
    with_null = df.unionByName(spark.sql("SELECT cast(NULL AS string) AS s"))
    for index in (small, large):
        attached = index.attach(with_null, with_null["s"], "i", keep_null=True)
        assert attached.count() == 561 and attached.filter("s = 'hot' AND i = 0").count() == 300
        assert index.attach(with_null, with_null["s"], "i").count() == 560


def test_values_whose_digests_collide(spark, monkeypatch):
    from scrubwell.functions import indexing
    from pyspark.sql import functions as F

    real = indexing.value_key
    monkeypatch.setattr(indexing, "value_key", lambda v, wide=False: real(v, True) if wide else F.substring(real(v), 1, 1))
    df = spark.range(3000).selectExpr("concat('v', id % 700) AS s")
    for limit in (1000, 10):
        index = frequency_index(df, "s", small_limit=limit)
        assert index.wide
        found = index.attach(df, F.col("s"), "i").distinct().collect()
        assert sorted(r["i"] for r in found) == list(map(float, range(700)))


@pytest.mark.parametrize("limit", [10, 100_000])
def test_no_value_is_broadcast(spark, limit):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = sw.index_target(docs, "text", small_limit=limit)._jdf.queryExecution().executedPlan().toString()
    modes = [line for line in plan.splitlines() if "BroadcastExchange HashedRelation" in line]
    assert modes and all("binary" in m or "input[0, int" in m for m in modes) and not any("string" in m for m in modes)


def test_bins_of_like_weight(spark):
    from pyspark.sql import functions as F

    from scrubwell.functions.indexing import dictionaries

    df = spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('v', id % 500) END AS s", "id % 500 * 1.0D AS y")
    for limit in (100_000, 10):
        binned = dictionaries(df, ["s"], F.col("y"), small_limit=limit)["s"].binned(8)
        rows_of = {r["__bin"]: r["n"] for r in binned.table.groupBy("__bin").agg(F.sum("__n").alias("n")).collect()}
        assert len(rows_of) <= 8 and sum(rows_of.values()) == 4000 and sorted(rows_of.values())[-2] <= 4000 / 8 + 8  # beside the hot value
        means = [r["m"] for r in binned.table.groupBy("__bin").agg((F.sum("__sum") / F.sum("__n")).alias("m")).orderBy("__bin").collect()]
        assert means == sorted(means)
        found = binned.look_up(df.unionByName(spark.sql("SELECT 'new' AS s, 0D AS y UNION ALL SELECT NULL, 0D")), F.col("s"), {"b": "__bin"})
        assert found.count() == 4002 and found.filter("b IS NULL").count() == 2


def test_non_string_target_is_kept(classes):
    assert sw.index_target(classes, "x") is classes


def test_correlation_pairs_and_constants(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 1, "p", 7), (2.0, 4.0, 1, "p", 7), (3.0, None, 1, "q", 7), (4.0, 8.0, 1, None, 7)],
        "y double, double_y double, one int, s string, price_index int",
    )
    found = {r["feature"]: r["correlation"] for r in sw.target_correlation(df, "y").collect()}
    # the pair with NULL is ignored, constant columns are left out, p=0 and q=1 over three rows
    assert found == {"double_y": 1.0, "s": 0.866}
    complete = {r["feature"]: r["correlation"] for r in sw.target_correlation(df, "y", complete_cases=True).collect()}
    assert complete == {"double_y": 1.0, "s": 0.866}


def test_string_features_over_the_limit_are_left_out(spark):
    df = spark.createDataFrame([(float(i), f"v{i % 99}", f"w{i % 100}") for i in range(400)], "y double, few string, many string")
    assert "many" not in by(sw.target_correlation(df, "y"), "feature")
    assert "few" in by(sw.target_correlation(df, "y"), "feature")
    with_null = df.unionByName(spark.sql("SELECT 1.0D AS y, cast(NULL AS string) AS few, 'w1' AS many"))
    assert "few" not in by(sw.target_correlation(with_null, "y"), "feature")  # NULL is the 100th value


def test_string_target(classes):
    found = by(sw.target_correlation(classes, "y"), "feature")
    rank = {"c": 0, "a": 1, "b": 2, "d": 3}
    pairs = [(rank[r["y"]], r["x"]) for r in classes.na.drop().collect()]
    assert found["x"]["correlation"] == round(float(np.corrcoef(np.array(pairs).T)[0, 1]), 3)
    assert rows(sw.target_correlation(classes.selectExpr("y = 'a' AS y", "x"), "y")) == []


def test_distribution_and_imbalance(classes):
    assert rows(sw.class_distribution(classes, "y")) == [(None, 2), ("a", 3), ("b", 3), ("c", 5), ("d", 1)]
    assert rows(sw.class_imbalance(classes, "y")) == [(5, 1, 5, True)]
    assert sw.is_imbalanced(classes, "y") and not sw.is_imbalanced(classes.filter("y IN ('a', 'b')"), "y")
    assert not sw.is_imbalanced(classes.limit(0), "y")
