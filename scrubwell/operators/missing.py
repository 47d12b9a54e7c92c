"""Missing values: counting them, listing the rows, dropping and filling."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.columns import (
    aggregate_row, as_double, is_floating, is_numeric, numeric_columns, ref, report, require, string_columns,
)
from scrubwell.functions.quantiles import quantiles
from scrubwell.functions.stats import missing

STRATEGIES = ("none", "drop", "mean", "median", "zero", "unknown")


SCHEMA = "column string, missing_count bigint"


def missing_lines(df: DataFrame) -> list[dict[str, Column]]:
    return [{"column": F.lit(c), "missing_count": F.count_if(missing(df, c))} for c in df.columns]


def missing_counts(df: DataFrame) -> DataFrame:
    """``(column, missing_count)``, most missing first. One scan for all columns."""
    require(df)
    return report(df, missing_lines(df), SCHEMA).orderBy(F.desc("missing_count"), "column")


def missing_rows(df: DataFrame) -> DataFrame:
    """The rows with at least one missing cell, as a lazy filter."""
    require(df)
    return df.filter(reduce(or_, [missing(df, c) for c in df.columns], F.lit(False)))


def missing_columns(df: DataFrame) -> DataFrame:
    """``(column, missing_count, is_numeric)`` for the columns that miss something.

    A numeric column among them is what makes the filling strategies useful.
    """
    numeric = numeric_columns(df)
    flag = F.col("column").isin(numeric) if numeric else F.lit(False)
    return missing_counts(df).filter("missing_count > 0").withColumn("is_numeric", flag)


def offered_strategies(df: DataFrame) -> list[str]:
    """The strategies that apply: fills only when a numeric column misses values."""
    fills = missing_columns(df).filter("is_numeric").limit(1).count() > 0
    return list(STRATEGIES) if fills else ["none", "drop"]


def empty_to_null(df: DataFrame) -> DataFrame:
    """Empty strings become NULL, so that dropping and filling see what detection calls missing."""
    return df.withColumns({c: F.nullif(ref(c), F.lit("")) for c in string_columns(df)})


def fill_columns(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """NULL (and NaN in floating columns) replaced by the value, cast to the type of the column."""
    if not values:
        return df
    return df.withColumns({name: filled(df, name, value) for name, value in values.items()})


def filled(df: DataFrame, name: str, value: object) -> Column:
    field, cell = df.schema[name], ref(name)
    if is_floating(field):
        cell = F.when(~F.isnan(cell), cell)
    literal = F.lit(value)
    if is_numeric(field) and not is_floating(field):
        literal = F.lit(int(value)) if "decimal" not in field.dataType.typeName() else F.lit(str(value))
    return F.coalesce(cell, literal.cast(field.dataType))


def handle_missing(
    df: DataFrame,
    strategy: str,
    mode: str = "approx",
    error: float = 0.01,
    empty_is_missing: bool = False,
    medians: dict[str, float] | None = None,
) -> DataFrame:
    """Apply one strategy. ``medians`` that are known already, such as those of stored states, save the pass that finds them.

    ``drop`` removes rows with a NULL or NaN; ``mean`` and ``median`` fill numeric columns (whole-number columns get
    the value cut to a whole number, a column without values is left alone); ``zero`` fills numeric columns and
    ``unknown`` string columns; ``none`` changes nothing.
    """
    require(df)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, expected one of {', '.join(STRATEGIES)}")
    if strategy == "none":
        return df
    if empty_is_missing:
        df = empty_to_null(df)
    numeric = numeric_columns(df)
    if strategy == "drop":
        return df.na.drop()
    if strategy == "zero":
        return fill_columns(df, dict.fromkeys(numeric, 0))
    if strategy == "unknown":
        return fill_columns(df, dict.fromkeys(string_columns(df), "Unknown"))
    if strategy == "mean":
        means = aggregate_row(df, [F.avg(as_double(df, c)) for c in numeric])
        return fill_columns(df, {c: v for c, v in zip(numeric, means) if v is not None})
    if medians is None:
        found = quantiles(df, numeric, [0.5], mode=mode, error=error)
        medians = {c: v[0] for c, v in found.items() if v is not None}
    return fill_columns(df, {c: medians[c] for c in numeric if c in medians})
