"""Reports from mergeable states: small tables that describe parts of the data and are added up without reading it again.

``table_states`` has a row per part and column, ``value_states`` one per part, string column and value. Both can be stored
beside the data, per file, day or partition; a new part adds its rows, and ``merge_states`` and ``merge_values`` turn any
selection of parts into the states of their union. Counts, extremes, moments and value counts merge exactly (moments up
to rounding), quantiles within ``RANK_ERROR`` of the rank, numbers of distinct values within ``DISTINCT_ERROR``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.columns import as_double, empty, is_floating, is_numeric, is_string, local_rows, ref, require
from scrubwell.functions.frequencies import INLINE_CHARS, RARE_SHARE, frequencies
from scrubwell.functions.stats import missing
from scrubwell.operators.outliers import IQR_FACTOR, bounds_from

# Size of a quantile sketch (some 12 kB) and the error of its ranks, which holds with a probability of 99 %.
SKETCH_K = 800
RANK_ERROR = 0.005
# Logarithm of the slots of a distinct sketch (some 4 kB), and three standard errors of its estimate.
DISTINCT_SLOTS = 12
DISTINCT_ERROR = 0.05

STATE = (
    "column string, type string, n_rows bigint, n_missing bigint, n bigint, n_nan bigint, mean double, m2 double, m3 double, "
    "low double, high double, quantiles binary, distinct binary"
)
_EXACT = ("n_rows", "n_missing", "n", "n_nan")


def _state(df: DataFrame, name: str) -> Column:
    """The state of one column as a struct of aggregates."""
    field = df.schema[name]
    null = F.lit(None)
    x = as_double(df, name) if is_numeric(field) else null.cast("double")
    n = F.count(x)
    spread = F.var_pop(x) * n
    cell = ref(name)
    plain = F.when(cell == 0, F.abs(cell)).otherwise(cell) if is_floating(field) else cell  # 0.0 and -0.0 are one value
    figures = {
        "column": F.lit(name), "type": F.lit(field.dataType.simpleString()), "n_rows": F.count(F.lit(1)), "n_missing": F.count_if(missing(df, name)),
        "n": n, "n_nan": F.count_if(F.isnan(cell)) if is_floating(field) else F.lit(0), "mean": F.avg(x), "m2": spread,
        # a constant column has no skewness but a third moment of 0
        "m3": F.when(spread == 0, 0.0).otherwise(F.skewness(x) * spread * F.sqrt(F.var_pop(x))),
        "low": F.min(x), "high": F.max(x), "quantiles": F.kll_sketch_agg_double(x, SKETCH_K) if is_numeric(field) else null,
        "distinct": F.hll_sketch_agg(F.concat(F.lit("="), plain.cast("string")), DISTINCT_SLOTS),  # a sketch skips empty texts
    }
    kinds = dict(part.strip().rsplit(" ", 1) for part in STATE.split(","))
    return F.struct(*[figures[c].cast(kind).alias(c) for c, kind in kinds.items()])


def table_states(df: DataFrame, part: Column | None = None) -> DataFrame:
    """A row per part and column of strings, numbers, times and truth values, from one scan; ``part`` names the part of a row
    (all rows are one by default). A table without rows has no parts.

    ``n`` counts numbers that are neither NULL nor NaN, and ``mean``, ``m2``, ``m3`` (sums of powers about the mean), ``low``, ``high``
    and the quantile sketch describe those; ``n_missing`` is NULL, or the empty string.
    """
    require(df)
    names = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary", "variant")]
    states = F.array(*[_state(df, n) for n in names])
    grouped = df.groupBy((F.lit("all") if part is None else part.cast("string")).alias("part"))
    return grouped.agg(states.alias("states")).select("part", F.inline("states"))


def value_states(df: DataFrame, names: Sequence[str] | None = None, part: Column | None = None) -> DataFrame:
    """``(part, column, value, n)`` of string columns: how often each value occurs, NULL being one. Values of more than 48
    characters are their SHA-256 after ``#``, others stand after ``=``."""
    require(df)
    names = [f.name for f in df.schema.fields if is_string(f)] if names is None else list(names)
    if part is None:
        counted = frequencies(df, names, keep_values=False).filter("n > 0")
        return counted.select(F.lit("all").alias("part"), "column", "value", "n")
    if not names:
        return empty(df, "part string, column string, value string, n bigint")
    short = lambda v: F.when(F.length(v) > INLINE_CHARS, F.concat(F.lit("#"), F.sha2(v, 256))).otherwise(F.concat(F.lit("="), v))
    cells = F.array(*[F.struct(F.lit(n).alias("column"), short(ref(n)).alias("value")) for n in names])
    long = df.select(part.cast("string").alias("part"), F.inline(cells))
    return long.groupBy("part", "column", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_states(states: DataFrame) -> DataFrame:
    """The states of the union of all parts, a row per column. Moments are shifted to the common mean before they are added."""
    means = states.groupBy("column").agg((F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("__mean"))
    both = states.join(F.broadcast(means), "column")  # a row per column
    d = F.col("mean") - F.col("__mean")
    constant = F.min("low") == F.max("high")  # rounding of the common mean is no spread
    m2 = F.when(constant, 0.0).otherwise(F.sum(F.col("m2") + F.col("n") * d * d))
    m3 = F.when(constant, 0.0).otherwise(F.sum(F.col("m3") + 3 * d * F.col("m2") + F.col("n") * d * d * d))
    found = both.groupBy("column").agg(
        F.first("type").alias("type"), *[F.sum(c).alias(c) for c in _EXACT], F.first("__mean").alias("mean"), m2.alias("m2"), m3.alias("m3"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )
    return found.select("column", "type", *_EXACT, "mean", "m2", "m3", "low", "high", F.when(F.col("n") > 0, F.col("quantiles")).alias("quantiles"), "distinct")


def merge_values(values: DataFrame) -> DataFrame:
    """``(column, value, n)`` of the union of all parts."""
    return values.groupBy("column", "value").agg(F.sum("n").alias("n"))


def quantiles_of_states(states: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``(column, p, value)`` of merged states: data values whose rank is within ``RANK_ERROR`` of ``p``."""
    known = states.filter(F.col("quantiles").isNotNull())
    cells = [F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))).alias("value")) for p in probs]
    return known.select("column", F.inline(F.array(*cells)))


def bounds_of_states(states: DataFrame, factor: float = IQR_FACTOR) -> dict[str, tuple[float, float, float, float]]:
    """``(q1, q3, lower, upper)`` of each numeric column with values, as outlier removal takes them; a row per column is
    collected."""
    found: dict[str, dict[float, float]] = {}
    for column, p, value in quantiles_of_states(states, (0.25, 0.75)).collect():
        found.setdefault(column, {})[p] = value
    return bounds_from({c: (q[0.25], q[0.75]) for c, q in found.items()}, factor)


def report_of_states(states: DataFrame, values: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
    """The parts of the issue report that follow from merged states: ``missing``, ``skewness``, ``high_skew``, ``outliers``, ``box``,
    ``distinct``, and with a string target ``classes`` and ``imbalance``.

    ``outliers`` has the bounds and, for numbers, an estimate of how many lie outside, which is exact where none does.
    """
    other = F.lit(True) if target is None else F.col("column") != target
    numbers = states.filter(F.col("type").rlike("^(double|float|int|bigint|smallint|tinyint|decimal)"))
    skewness = F.when(F.col("n_nan") > 0, F.lit(float("nan"))).otherwise(F.sqrt("n") * F.col("m3") / F.nullif(F.pow("m2", F.lit(1.5)), F.lit(0.0)))
    skews = numbers.select("column", skewness.alias("skewness"))

    sizes = values.groupBy("column").agg(F.sum("n").alias("n_rows"))
    shares = values.join(F.broadcast(sizes), "column")  # a row per column
    summed = shares.groupBy("column", "n_rows").agg(
        F.sum(F.col("n") * F.log2("n")).alias("weighted"), F.count_if(F.col("n") / F.col("n_rows") < RARE_SHARE).alias("n_rare")
    )
    entropy = summed.select("column", (F.log2("n_rows") - F.col("weighted") / F.col("n_rows")).alias("entropy"), "n_rare").filter(other)

    none = F.lit(None).cast("double")
    found = bounds_of_states(states.filter(other))
    limits = local_rows(states.sparkSession, [(c, *b) for c, b in found.items()], "column string, q1 double, q3 double, lower_bound double, upper_bound double")
    rank = lambda at: F.coalesce(  # noqa: E731  a sketch takes constants only
        *[F.when(F.col("column") == c, F.kll_sketch_get_rank_double("quantiles", F.lit(float(b[at])))) for c, b in found.items()], F.lit(0.0)
    )
    inside = (F.col("low") >= F.col("lower_bound")) & (F.col("high") <= F.col("upper_bound"))
    outside = F.greatest(F.lit(0.0), F.lit(1.0) - rank(3) + rank(2))
    estimate = F.when(inside, F.lit(0)).otherwise(F.round(F.col("n") * outside)).cast("bigint")
    rounded = [F.round(c, 2).alias(c) for c in ("q1", "q3", "lower_bound", "upper_bound")]
    numeric = states.join(F.broadcast(limits), "column").select("column", F.lit("Numeric").alias("type"), estimate.alias("outlier_count"), *rounded)
    rare = entropy.select("column", F.lit("Categorical").alias("type"), F.col("n_rare").alias("outlier_count"), *[none.alias(c) for c in ("q1", "q3", "lower_bound", "upper_bound")])

    at = lambda p: F.kll_sketch_get_quantile_double("quantiles", F.lit(p))
    result = {
        "missing": states.select("column", F.col("n_missing").alias("missing_count")).orderBy(F.desc("missing_count"), "column"),
        "skewness": skews.filter(other)
        .select("column", F.lit("Numeric").alias("type"), F.round("skewness", 3).alias("skewness"), none.alias("entropy"))
        .unionByName(entropy.select("column", F.lit("Categorical").alias("type"), none.alias("skewness"), F.round("entropy", 3).alias("entropy")))
        .orderBy("column"),
        "high_skew": skews.filter(~F.isnan("skewness") & (F.abs("skewness") > 1.0)).select("column", F.round("skewness", 3).alias("skewness")).orderBy("column"),
        "outliers": numeric.unionByName(rare).orderBy(F.desc("outlier_count"), "column"),
        "box": states.filter("n > 0").select("column", "n", F.col("low").alias("min"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.col("high").alias("max")),
        "distinct": states.select("column", F.hll_sketch_estimate("distinct").alias("n_distinct")),
    }
    if target is not None:
        classes = values.filter(F.col("column") == target).select(F.substring("value", 2, 64).alias("class"), "n")
        result["classes"] = classes.orderBy("class")
        largest, smallest = F.max("n"), F.min("n")
        result["imbalance"] = classes.agg(
            F.count(F.lit(1)).alias("n_classes"), smallest.alias("smallest"), largest.alias("largest"), (largest > 1.5 * smallest).alias("imbalanced")
        )
    return result
