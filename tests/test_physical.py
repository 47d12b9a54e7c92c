"""What the plans look like, since that is what decides at scale."""

import pytest
from pyspark.sql import functions as F

import scrubwell as sw
from scrubwell.functions.frequencies import categorical_summary

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def jobs(spark, action):
    """Number of Spark jobs that ``action`` starts."""
    group = f"count-{id(action)}"
    context = spark.sparkContext
    context.setJobGroup(group, group)
    action()
    found = len(context.statusTracker().getJobIdsForGroup(group))
    context.setLocalProperty("spark.jobGroup.id", None)
    return found


@pytest.mark.parametrize(
    "operator",
    [
        lambda df: sw.missing_counts(df).collect(),
        lambda df: sw.numeric_skewness(df).collect(),
        lambda df: sw.outlier_report(df).collect(),
        lambda df: sw.skewness_report(df).collect(),
        lambda df: sw.column_profile(df).collect(),
    ],
)
def test_jobs_do_not_grow_with_columns(spark, operator):
    narrow = spark.range(50).selectExpr("id AS n0", "cast(id % 3 AS string) AS s0")
    wide = spark.range(50).selectExpr(
        *[f"id * {i} AS n{i}" for i in range(6)], *[f"cast(id % {i + 2} AS string) AS s{i}" for i in range(6)]
    )
    operator(narrow)
    assert jobs(spark, lambda: operator(wide)) <= jobs(spark, lambda: operator(narrow))


def test_only_needed_columns_are_read(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    text = plan(sw.numeric_skewness(events))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in text
    assert "ReadSchema: struct<event_type:string>" in plan(sw.class_distribution(events, "event_type"))


def test_filters_reach_the_scan(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    cleaned = sw.remove_outliers(events.select("event_id", "value"), "event_id")
    assert "GreaterThanOrEqual(value" in plan(cleaned)


def test_the_frequency_table_is_computed_once(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    summary = categorical_summary(events, ["event_type", "props"])
    summary.collect()
    text = plan(summary)
    final = text[: text.find("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_undersampling_does_not_shuffle_rows(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").drop("ts")
    assert "Exchange hashpartitioning" not in plan(sw.undersample(events, "event_type"))


def test_unique_rows_pass_deduplication_without_a_shuffle(spark):
    df = spark.range(100).select(F.col("id"), F.concat(F.lit("t"), "id").alias("t"))
    cleaned = sw.drop_duplicates(df)
    cleaned.collect()
    assert cleaned.count() == 100
    assert "LeftAnti" in plan(cleaned)
