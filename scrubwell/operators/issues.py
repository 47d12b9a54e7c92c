"""All issues of a table in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.columns import fused_reports, local_rows, numeric_columns, require, string_columns
from scrubwell.functions.frequencies import SUMMARY_SCHEMA, categorical_summary
from scrubwell.functions.quantiles import quantiles
from scrubwell.operators import classes, duplicates, missing, outliers, skew, target as targets, timestamps
from scrubwell.operators.features import TASKS
from scrubwell.sources.tables import schema_listing


def issue_report(
    df: DataFrame,
    target: str,
    task: str,
    mode: str = "approx",
    error: float = outliers.QUARTILE_ERROR,
) -> dict[str, DataFrame]:
    """Schema, missing values, duplicates, skew, outliers, correlation and, for classes, their balance.

    Calendar parts of timestamps are added first. However wide the table, one job finds the quartiles, one computes
    all per-column figures and one counts the categories. The rows of the duplicate groups and those with missing cells,
    which grow with the data, are not computed until they are asked for.
    """
    require(df, target)
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}, expected one of {', '.join(TASKS)}")
    spark = df.sparkSession
    wide = timestamps.timestamp_features(df)
    quartiles = quantiles(wide, numeric_columns(wide), (0.25, 0.5, 0.75), mode=mode, error=error)
    bounds = outliers.bounds_from({c: (q[0], q[2]) for c, q in quartiles.items() if q and c != target})
    figures = fused_reports(
        wide,
        {
            "missing": (missing.missing_lines(wide), missing.SCHEMA),
            "skewness": (skew.skewness_lines(wide, target), skew.SCHEMA),
            "high_skew": (skew.high_skew_lines(wide), skew.HIGH_SKEW_SCHEMA),
            "outliers": (outliers.outlier_lines(bounds), outliers.SCHEMA),
            "box": (outliers.box_lines(wide, quartiles), outliers.BOX_SCHEMA),
        },
    )
    summary = categorical_summary(wide, string_columns(wide, [target]))
    summary = local_rows(spark, summary.collect(), SUMMARY_SCHEMA)  # a row per column
    result = {
        "schema": schema_listing(df),
        "missing": figures["missing"].orderBy(F.desc("missing_count"), "column"),
        "missing_rows": missing.missing_rows(wide),
        "duplicates": duplicates.duplicate_groups(wide, target),
        "skewness": figures["skewness"].unionByName(skew.categorical_entropy(wide, target, summary)).orderBy("column"),
        "high_skew": skew.above_threshold(figures["high_skew"], 1.0),
        "outliers": figures["outliers"]
        .unionByName(outliers.rare_categories(wide, target, summary))
        .orderBy(F.desc("outlier_count"), "column"),
        "box": figures["box"],
        "correlation": targets.target_correlation(wide, target),
    }
    if task != "regression":
        result["classes"] = classes.class_distribution(wide, target)
        result["imbalance"] = classes.class_imbalance(wide, target)
    return result


def issue_table(df: DataFrame, target: str, task: str, mode: str = "approx") -> DataFrame:
    """The report as one table ``(issue, item, value)``, the per-row parts as counts."""
    parts = issue_report(df, target, task, mode)

    def line(name: str, item: str, value: str) -> DataFrame:
        return parts[name].select(
            F.lit(name).alias("issue"), F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value")
        )

    table = line("missing", "column", "missing_count")
    skews = parts["skewness"].select(
        F.lit("skewness").alias("issue"), F.col("column").alias("item"), F.coalesce("skewness", "entropy").alias("value")
    )
    groups = parts["duplicates"].agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("duplicates").alias("issue"), F.lit("groups").alias("item"), "value"
    )
    for part in (
        skews, groups, line("high_skew", "column", "skewness"), line("outliers", "column", "outlier_count"),
        line("correlation", "feature", "correlation"),
    ):
        table = table.unionByName(part)
    if "classes" in parts:
        table = table.unionByName(line("classes", "class", "n"))
        table = table.unionByName(
            parts["imbalance"].select(
                F.lit("imbalance").alias("issue"), F.lit(target).alias("item"), F.col("imbalanced").cast("int").cast("double").alias("value")
            )
        )
    return table
