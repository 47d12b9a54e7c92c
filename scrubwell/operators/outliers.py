"""Numbers far outside the quartiles, categories that are rare, box-plot figures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.columns import as_double, numeric_columns, ref, report, require, string_columns
from scrubwell.functions.frequencies import summary_of
from scrubwell.functions.quantiles import quantiles

# Bounds lie this many interquartile ranges outside the quartiles, whisker ends that many.
IQR_FACTOR = 5.0
WHISKER_FACTOR = 1.5
QUARTILES = (0.25, 0.75)
QUARTILE_ERROR = 0.05

SCHEMA = (
    "column string, type string, outlier_count bigint, q1 double, q3 double, lower_bound double, upper_bound double"
)
BOX_SCHEMA = (
    "column string, n bigint, min double, q1 double, median double, q3 double, max double, "
    "whisker_low double, whisker_high double, n_fliers bigint"
)


def iqr_bounds(
    df: DataFrame, names: Sequence[str], factor: float = IQR_FACTOR, mode: str = "approx", error: float = QUARTILE_ERROR
) -> dict[str, tuple[float, float, float, float]]:
    """``(q1, q3, lower, upper)`` of each column that has values, all columns in one pass."""
    found = quantiles(df, names, QUARTILES, mode=mode, error=error)
    return bounds_from({c: tuple(q) for c, q in found.items() if q is not None}, factor)


def bounds_from(
    quartiles: dict[str, tuple[float, float]], factor: float = IQR_FACTOR
) -> dict[str, tuple[float, float, float, float]]:
    return {
        c: (q1, q3, q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)) for c, (q1, q3) in quartiles.items()
    }


def outlier_lines(bounds: dict[str, tuple[float, float, float, float]]) -> list[dict[str, Column]]:
    lines = []
    for c, (q1, q3, lower, upper) in bounds.items():
        cell = ref(c).cast("double")
        lines.append(
            {
                "column": F.lit(c),
                "type": F.lit("Numeric"),
                "outlier_count": F.count_if((cell < lower) | (cell > upper)),
                **{k: F.round(F.lit(v), 2) for k, v in
                   (("q1", q1), ("q3", q3), ("lower_bound", lower), ("upper_bound", upper))},
            }
        )
    return lines


def numeric_outliers(
    df: DataFrame, target: str | None = None, mode: str = "approx", error: float = QUARTILE_ERROR
) -> DataFrame:
    """Values outside the bounds per numeric column but the target; columns without values are left out."""
    require(df, target)
    bounds = iqr_bounds(df, numeric_columns(df, [target]), mode=mode, error=error)
    return report(df, outlier_lines(bounds), SCHEMA)


def rare_categories(df: DataFrame, target: str | None = None, summary: DataFrame | None = None) -> DataFrame:
    """Number of distinct values (NULL is one) below a tenth of the rows, per string column but the target."""
    require(df, target)
    none = F.lit(None).cast("double")
    return summary_of(df, string_columns(df, [target]), summary).select(
        "column", F.lit("Categorical").alias("type"), F.col("n_rare").alias("outlier_count"),
        none.alias("q1"), none.alias("q3"), none.alias("lower_bound"), none.alias("upper_bound"),
    )


def outlier_report(
    df: DataFrame, target: str | None = None, mode: str = "approx", error: float = QUARTILE_ERROR
) -> DataFrame:
    """Numeric outliers and rare categories in one table, most affected first."""
    both = numeric_outliers(df, target, mode, error).unionByName(rare_categories(df, target))
    return both.orderBy(F.desc("outlier_count"), "column")


def box_lines(df: DataFrame, quartiles: dict[str, list[float] | None]) -> list[dict[str, Column]]:
    lines = []
    for c, q in quartiles.items():
        if q is None:
            continue
        q1, median, q3 = q
        low, high = q1 - WHISKER_FACTOR * (q3 - q1), q3 + WHISKER_FACTOR * (q3 - q1)
        cell = as_double(df, c)
        lines.append(
            {
                "column": F.lit(c),
                "n": F.count(cell),
                "min": F.min(cell),
                "q1": F.lit(q1),
                "median": F.lit(median),
                "q3": F.lit(q3),
                "max": F.max(cell),
                "whisker_low": F.min(F.when(cell >= low, cell)),
                "whisker_high": F.max(F.when(cell <= high, cell)),
                "n_fliers": F.count_if((cell < low) | (cell > high)),
            }
        )
    return lines


def box_stats(df: DataFrame, mode: str = "approx", error: float = QUARTILE_ERROR) -> DataFrame:
    """What a box plot of every numeric column shows: extremes, quartiles, whisker ends and the number of fliers.

    A whisker ends at the furthest value within 1.5 interquartile ranges of its quartile.
    """
    require(df)
    quartiles = quantiles(df, numeric_columns(df), (0.25, 0.5, 0.75), mode=mode, error=error)
    return report(df, box_lines(df, quartiles), BOX_SCHEMA)


def remove_outliers(
    df: DataFrame,
    target: str | None = None,
    mode: str = "approx",
    order: str = "joint",
    error: float = QUARTILE_ERROR,
    keep_nulls: bool = False,
    bounds: dict[str, tuple[float, float, float, float]] | None = None,
) -> DataFrame:
    """Rows with a numeric cell outside its bounds removed; the target is not looked at. ``bounds`` that are known already,
    such as those of stored states, save the pass that finds them.

    ``order="joint"`` takes all bounds from the input in one pass and filters once. ``order="sequential"`` takes the
    bounds of each column from the rows that the columns before it left, which needs a pass per column. NULL and NaN
    lie within no bounds, so their rows go too unless ``keep_nulls``. A column without values is skipped.
    """
    require(df, target)
    if order not in ("joint", "sequential"):
        raise ValueError(f"order is 'joint' or 'sequential', not {order!r}")
    names = numeric_columns(df, [target])

    def within(frame: DataFrame, bounds) -> DataFrame:
        tests = []
        for c, (_, _, lower, upper) in bounds.items():
            cell = ref(c).cast("double")
            test = cell.between(lower, upper)
            tests.append(as_double(frame, c).isNull() | test if keep_nulls else test)
        return frame.filter(reduce(and_, tests)) if tests else frame

    if bounds is not None:
        return within(df, {c: bounds[c] for c in names if c in bounds})
    if order == "joint":
        return within(df, iqr_bounds(df, names, mode=mode, error=error))
    for c in names:
        df = within(df, iqr_bounds(df, [c], mode=mode, error=error))
    return df
