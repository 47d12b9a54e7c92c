"""Calendar parts of timestamp columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.columns import date_columns, ref, require, timestamp_columns, unused_name

PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "dow": F.dayofweek,
}


def expand_dates(
    df: DataFrame, parts: Sequence[str], exclude: Sequence[str | None] = (), drop: bool = False
) -> DataFrame:
    """Add ``<column>_<part>`` for each timestamp and date column (a date has no hour); optionally drop the column.

    Where the table has a column of that name, the new one gets a number at its end and the table's own stays.
    """
    require(df)
    stamps, dates = timestamp_columns(df, exclude), date_columns(df, exclude)
    taken = {c.lower() for c in df.columns}
    added = {}
    for c in df.columns:
        for part in parts:
            if c in stamps or c in dates and part != "hour":
                name = unused_name(f"{c}_{part}", taken)
                taken.add(name.lower())
                added[name] = PARTS[part](ref(c))
    if not added:
        return df
    df = df.withColumns(added)
    return df.drop(*[ref(c) for c in stamps + dates]) if drop else df


def timestamp_features(df: DataFrame) -> DataFrame:
    """Year, month, day, hour and day of week (Sunday is 1) beside each timestamp column, which stays."""
    return expand_dates(df, list(PARTS))
