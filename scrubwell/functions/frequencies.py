"""The value-count table of many columns, built in one scan and one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from scrubwell.functions.columns import empty, is_floating, name_table, ref

SCHEMA = "column string, value string, n bigint"
SUMMARY_SCHEMA = "column string, n_rows bigint, n_values bigint, entropy double, n_rare bigint"
# Longer values travel as a digest when only the group sizes matter.
INLINE_CHARS = 48
# Fixed value: a category below this share of the rows is rare.
RARE_SHARE = 0.1


def frequencies(df: DataFrame, names: Sequence[str], keep_values: bool = True) -> DataFrame:
    """``(column, value, n)`` for each distinct value of each column; NULL is a value of its own.

    Each column also gets one ``(column, NULL, 0)`` row, so that none vanishes from the report on an empty table;
    readers of single values filter on ``n > 0``. With ``keep_values=False`` long texts are replaced by a SHA-256 digest: the groups are the same, while
    the shuffle carries 66 bytes for a value instead of the text.
    """
    if not names:
        return empty(df, SCHEMA)
    cells = []
    for n in names:
        value = ref(n)
        if is_floating(df.schema[n]):
            value = F.when(value == 0, F.abs(value)).otherwise(value)  # 0.0 and -0.0 are one value
        elif isinstance(df.schema[n].dataType, T.TimestampType) and not keep_values:
            value = F.unix_micros(value)  # two instants of the hour that is repeated in autumn print alike
        cell = value.cast("string")
        if not keep_values:
            cell = F.when(F.length(cell) > INLINE_CHARS, F.concat(F.lit("#"), F.sha2(cell, 256))).otherwise(
                F.concat(F.lit("="), cell)
            )
        cells.append(cell)
    flat = df.select(*[c.alias(n) for c, n in zip(cells, names)])
    long = flat.unpivot([], [ref(n) for n in names], "column", "value")
    counted = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    zeros = name_table(df, names).select(
        "column", F.lit(None).cast("string").alias("value"), F.lit(0).cast("bigint").alias("n")
    )
    return counted.unionByName(zeros)


def totals(freq: DataFrame) -> DataFrame:
    """Rows and distinct values (NULL counts as one) per column: a row per column, whatever the size of the table."""
    return freq.groupBy("column").agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 0).alias("n_values"))


def categorical_summary(df: DataFrame, names: Sequence[str], rare_share: float = RARE_SHARE) -> DataFrame:
    """``(column, n_rows, n_values, entropy, n_rare)``: everything said about categories, from one frequency table.

    Entropy is in bits, as log2(N) - sum(n*log2 n)/N, and 0 without rows; rare are the values below ``rare_share``.
    Spark runs the frequency table once, since both sides of the join share its shuffle.
    """
    freq = frequencies(df, names, keep_values=False)
    # one row per column, so the broadcast is bounded by the width of the table
    shares = freq.join(F.broadcast(totals(freq)), "column")
    weighted = F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2(F.col("n"))))
    rare = (F.col("n") > 0) & (F.try_divide(F.col("n"), F.col("n_rows")) < rare_share)
    summed = shares.groupBy("column", "n_rows", "n_values").agg(
        weighted.alias("__weighted"), F.count_if(rare).alias("n_rare")
    )
    entropy = F.when(F.col("n_rows") > 0, F.log2("n_rows") - F.col("__weighted") / F.nullif("n_rows", F.lit(0)))
    return summed.select("column", "n_rows", "n_values", F.coalesce(entropy, F.lit(0.0)).alias("entropy"), "n_rare")


def summary_of(df: DataFrame, names: Sequence[str], summary: DataFrame | None) -> DataFrame:
    """The lines of ``names`` from a given summary, or a new one."""
    if summary is None:
        return categorical_summary(df, names)
    return summary.filter(F.col("column").isin(list(names)))
