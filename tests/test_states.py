"""States of parts, merged, against the operators on the whole table."""

import pytest
from pyspark.sql import functions as F

import scrubwell as sw
from helpers import by, rows
from test_physical import jobs


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(4000).selectExpr(
        "id", "id % 7 AS part", "CASE WHEN id % 9 = 0 THEN NULL WHEN id % 501 = 1 THEN 1e6 + id ELSE sqrt(id) END AS x", "cast(id % 50 AS decimal(9,2)) AS d",
        "CASE id % 11 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('v', floor(sqrt(id % 50))) END AS s", "repeat(concat('long', id % 3), 30) AS t",
        "7 AS one", "cast(NULL AS double) AS none", "CASE WHEN id = 5 THEN cast('NaN' AS double) ELSE 1.0 * id END AS f", "timestamp_seconds(id * 9000) AS ts",
    )


def report(df, part, target="s"):
    states, values = sw.table_states(df, part), sw.value_states(df, part=part)
    return sw.report_of_states(sw.merge_states(states), sw.merge_values(values), target)


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_merged_parts_report_what_the_whole_does(table, parts):
    found = report(table, None if parts is None else F.col("id") % parts)
    assert rows(found["missing"]) == rows(sw.missing_counts(table))
    assert rows(found["skewness"].fillna(-9.0)) == rows(sw.skewness_report(table, "s").fillna(-9.0))
    assert rows(found["high_skew"]) == rows(sw.high_skew_columns(table))
    rare = found["outliers"].filter("type = 'Categorical'")
    assert rows(rare) == rows(sw.rare_categories(table, "s"))
    assert rows(found["classes"]) == rows(sw.class_distribution(table, "s"))
    assert rows(found["imbalance"]) == rows(sw.class_imbalance(table, "s"))
    exact, near = by(sw.box_stats(table, mode="exact")), by(found["box"])
    assert set(exact) == set(near) and "none" not in near
    for column, box in near.items():
        assert (box["n"], box["min"], box["max"]) == (exact[column]["n"], exact[column]["min"], exact[column]["max"])


def test_quantiles_and_outliers_within_the_stated_error(table):
    from scrubwell.operators.states import DISTINCT_ERROR, RANK_ERROR

    found = report(table, F.col("id") % 7)
    quartiles = sw.quantiles_of_states(sw.merge_states(sw.table_states(table, F.col("id") % 7)), [0.25, 0.5, 0.75]).collect()
    for column, p, value in quartiles:
        cell = F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))
        n, below, upto = table.agg(F.count(cell), F.count_if(cell < value), F.count_if(cell <= value)).first()
        assert below / n <= p + RANK_ERROR and upto / n >= p - RANK_ERROR
    outliers, exact = by(found["outliers"]), by(sw.outlier_report(table, "s", mode="exact"))
    assert abs(outliers["x"]["outlier_count"] - exact["x"]["outlier_count"]) <= 2 * RANK_ERROR * 4000 and exact["x"]["outlier_count"] > 0
    assert outliers["d"]["outlier_count"] == exact["d"]["outlier_count"] == 0
    distinct = by(found["distinct"])
    for column in ("id", "x", "d", "s", "t", "one", "none", "ts"):
        n = table.agg(F.count_distinct(column)).first()[0]
        assert abs(distinct[column]["n_distinct"] - n) <= DISTINCT_ERROR * n


def test_states_survive_storage_and_merge_again(spark, table, tmp_path):
    path = str(tmp_path / "states")
    for part in range(3):
        sw.table_states(table.filter(F.col("id") % 3 == part), F.lit(part)).write.mode("append").parquet(path)
    once = sw.merge_states(spark.read.parquet(path))
    halves = [sw.merge_states(spark.read.parquet(path).filter(f)) for f in ("part < 2", "part = 2")]
    again = sw.merge_states(halves[0].unionByName(halves[1]))
    plain = ["column", "n_rows", "n_missing", "n", "n_nan", "low", "high"]
    assert rows(once.select(*plain)) == rows(again.select(*plain))
    moments = [{r["column"]: (r["mean"], r["m2"], r["m3"]) for r in s.collect()} for s in (once, again)]
    for column, wanted in moments[0].items():
        for a, b in zip(wanted, moments[1][column]):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-6))


def test_empty_tables_and_odd_types(spark, nulls):
    nothing = spark.createDataFrame([], "a int, s string, list array<int>")
    states = sw.table_states(nothing)
    assert rows(sw.merge_states(states).select("column", "n")) in ([], [("a", 0), ("s", 0)])
    assert sw.value_states(nothing, part=F.lit(1)).count() == 0 and sw.value_states(nothing, []).count() == 0
    found = report(nulls, F.lit("p"), "y")
    assert by(found["missing"])["none"]["missing_count"] == 4 and "none" not in by(found["box"])
    assert rows(found["missing"]) == rows(sw.missing_counts(nulls))


def test_known_bounds_and_medians_save_the_pass(spark, table):
    states = sw.merge_states(sw.table_states(table, F.col("id") % 7))
    bounds = sw.bounds_of_states(states)
    medians = {r["column"]: r["value"] for r in sw.quantiles_of_states(states, [0.5]).collect()}
    plain = table.select("id", "x", "d")
    assert jobs(spark, lambda: sw.remove_outliers(plain, bounds=bounds)) == 0
    kept = sw.remove_outliers(plain, bounds=bounds, keep_nulls=True)
    assert kept.filter("x >= 1e6").count() == 0 and kept.count() > 3900
    assert jobs(spark, lambda: sw.handle_missing(plain, "median", medians=medians)) == 0
    assert rows(sw.handle_missing(plain, "median", medians=medians).filter("id = 9").select("x")) == [(medians["x"],)]
