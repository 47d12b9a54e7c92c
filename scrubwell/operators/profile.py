"""A profile of every column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubwell.functions.columns import as_double, empty, is_numeric, numeric_columns, ref, report, require
from scrubwell.functions.frequencies import frequencies, totals
from scrubwell.functions.quantiles import quantiles
from scrubwell.functions.stats import missing

# Groups by digest in which the values of a column are ranked before all of it is.
GROUPS = 64
PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)
SCHEMA = (
    "column string, type string, n bigint, n_missing bigint, p_missing double, n_distinct bigint, "
    "min double, max double, mean double, std double, n_zeros bigint, "
    "q05 double, q25 double, q50 double, q75 double, q95 double, min_text string, max_text string"
)


def _profiled(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def column_profile(df: DataFrame, mode: str = "approx", error: float = 0.01) -> DataFrame:
    """A row per column: size, missing and distinct values, moments and quantiles of numbers, extremes of the rest.

    ``approx`` estimates distinct counts within the same scan; ``exact`` counts them from the frequency table.
    Nested columns are left out.
    """
    require(df)
    names = _profiled(df)
    found = quantiles(df, numeric_columns(df), PROBS, mode=mode, error=error)
    lines = []
    for c in names:
        field, cell = df.schema[c], ref(c)
        number = as_double(df, c) if is_numeric(field) else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if is_numeric(field) else cell
        qs = found.get(c) or [None] * len(PROBS)
        gaps = F.count_if(missing(df, c))
        lines.append(
            {
                "column": F.lit(c),
                "type": F.lit(field.dataType.simpleString()),
                "n": F.count(F.lit(1)),
                "n_missing": gaps,
                "p_missing": gaps / F.nullif(F.count(F.lit(1)), F.lit(0)),
                "n_distinct": F.lit(None) if mode == "exact" else F.approx_count_distinct(cell),
                "min": F.min(number),
                "max": F.max(number),
                "mean": F.avg(number),
                "std": F.stddev_samp(number),
                "n_zeros": F.count_if(number == 0),
                **{k: F.lit(q) for k, q in zip(("q05", "q25", "q50", "q75", "q95"), qs)},
                "min_text": F.min(text),
                "max_text": F.max(text),
            }
        )
    profile = report(df, lines, SCHEMA)
    if mode != "exact" or not names:
        return profile
    freq = frequencies(df, names, keep_values=False).filter(F.col("value").isNotNull() | (F.col("n") == 0))
    # one row per column
    counted = totals(freq).select("column", F.col("n_values").alias("__k"))
    order = [f.name for f in T._parse_datatype_string(SCHEMA).fields]
    return (
        profile.drop("n_distinct").join(F.broadcast(counted), "column").withColumnRenamed("__k", "n_distinct").select(*order)
    )


def top_values(df: DataFrame, k: int = 10) -> DataFrame:
    """``(column, rank, value, n)``: the ``k`` most frequent values of each column, ties in value order.

    Values are ranked inside ``GROUPS`` groups per column first, by digest; the final ranking sees ``k`` of each at most, so no task
    holds all values of a column however large ``k`` is.
    """
    require(df)
    names = _profiled(df)
    if not names:
        return empty(df, "column string, rank int, value string, n bigint")
    freq = frequencies(df, names).filter("n > 0")
    order = (F.desc("n"), F.asc_nulls_last("value"))
    grouped = freq.withColumn("__group", F.pmod(F.xxhash64("value"), F.lit(GROUPS)))
    first = F.row_number().over(Window.partitionBy("column", "__group").orderBy(*order))
    best = grouped.withColumn("__first", first).filter(F.col("__first") <= k).drop("__group", "__first")
    place = F.row_number().over(Window.partitionBy("column").orderBy(*order))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("column", "rank", "value", "n")
