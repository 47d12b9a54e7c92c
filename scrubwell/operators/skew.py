"""Skewness of numbers, entropy of categories, and transforms against high skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.columns import aggregate_row, numeric_columns, ref, report, require, string_columns
from scrubwell.functions.frequencies import summary_of

SCHEMA = "column string, type string, skewness double, entropy double"
TRANSFORMS = {
    "log": F.log1p,
    "sqrt": F.sqrt,
    "cbrt": F.cbrt,
}


HIGH_SKEW_SCHEMA = "column string, skewness double"


def skewness_lines(df: DataFrame, target: str | None = None) -> list[dict[str, Column]]:
    return [
        {
            "column": F.lit(c),
            "type": F.lit("Numeric"),
            "skewness": F.round(F.skewness(ref(c).cast("double")), 3),
            "entropy": F.lit(None),
        }
        for c in numeric_columns(df, [target])
    ]


def numeric_skewness(df: DataFrame, target: str | None = None) -> DataFrame:
    """Population skewness of each numeric column but the target, 3 decimals, NULL for a constant or empty column."""
    require(df, target)
    return report(df, skewness_lines(df, target), SCHEMA)


def categorical_entropy(df: DataFrame, target: str | None = None, summary: DataFrame | None = None) -> DataFrame:
    """Shannon entropy in bits of each string column but the target, NULL being a category, 3 decimals."""
    require(df, target)
    return summary_of(df, string_columns(df, [target]), summary).select(
        "column",
        F.lit("Categorical").alias("type"),
        F.lit(None).cast("double").alias("skewness"),
        F.round("entropy", 3).alias("entropy"),
    )


def skewness_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """Skewness of the numeric and entropy of the string columns, by column name."""
    return numeric_skewness(df, target).unionByName(categorical_entropy(df, target)).orderBy("column")


def high_skew_lines(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[dict[str, Column]]:
    return [
        {"column": F.lit(c), "skewness": F.skewness(ref(c).cast("double"))} for c in numeric_columns(df, exclude)
    ]


def above_threshold(skews: DataFrame, threshold: float) -> DataFrame:
    # a column with a NaN has no skewness; NaN would pass as larger than anything
    high = skews.filter(~F.isnan("skewness") & (F.abs("skewness") > threshold))
    return high.select("column", F.round("skewness", 3).alias("skewness")).orderBy("column")


def high_skew_columns(df: DataFrame, threshold: float = 1.0, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``(column, skewness)`` of the numeric columns, the target included, whose skewness exceeds ``threshold`` in size."""
    require(df)
    return above_threshold(report(df, high_skew_lines(df, exclude), HIGH_SKEW_SCHEMA), threshold)


def skewed_names(df: DataFrame, threshold: float = 1.0, exclude: tuple[str, ...] = ()) -> list[str]:
    """The same names in table order, from one job."""
    require(df)
    names = numeric_columns(df, exclude)
    values = aggregate_row(df, [F.skewness(ref(c).cast("double")) for c in names])
    return [c for c, v in zip(names, values) if v is not None and abs(v) > threshold]


def fix_skew(
    df: DataFrame,
    method: str = "log",
    threshold: float = 1.0,
    target: str | None = None,
    include_target: bool = True,
) -> tuple[DataFrame, list[str]]:
    """Transform the highly skewed numeric columns; the new table and the names of the changed columns.

    ``log`` is log(1+x), NULL at or below -1; ``sqrt`` is NaN below 0; ``cbrt`` keeps the sign. The target is
    transformed like any other column unless ``include_target`` is off.
    """
    if method not in TRANSFORMS:
        raise ValueError(f"unknown method {method!r}, expected one of: {', '.join(TRANSFORMS)}")
    exclude = (target,) if target is not None and not include_target else ()
    names = skewed_names(df, threshold, exclude)
    if not names:
        return df, []
    return df.withColumns({c: TRANSFORMS[method](ref(c).cast("double")) for c in names}), names
