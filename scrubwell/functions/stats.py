"""Aggregate expressions used by more than one operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.columns import is_string, ref


def missing(df: DataFrame, name: str) -> Column:
    """True where the cell is NULL, or the empty string in a string column."""
    cell = ref(name)
    return (cell.isNull() | (cell == "")) if is_string(df.schema[name]) else cell.isNull()


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are present; NULL when either is constant there."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
