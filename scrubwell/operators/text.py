"""Cleaning of text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from scrubwell.functions.columns import is_string, ref, require
from scrubwell.functions.text import clean_text


def clean_text_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower-case the columns, remove links and tidy blanks, as expressions inside generated code."""
    require(df, *columns)
    wrong = [c for c in columns if not is_string(df.schema[c])]
    if wrong:
        raise ValueError(f"not text columns: {wrong}")
    return df.withColumns({c: clean_text(ref(c)) for c in columns}) if columns else df
