"""The target column: numeric labels for classes, and how strongly each feature goes with it."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubwell.functions.columns import (
    aggregate_row, empty, is_numeric, is_string, local_rows, numeric_columns, ref, require, string_columns,
)
from scrubwell.functions.frequencies import frequencies, totals
from scrubwell.functions.indexing import SMALL_INDEX, frequency_index
from scrubwell.functions.stats import pearson

# Fixed value: a string feature with this many distinct values (NULL counts) or more is not indexed.
CATEGORY_LIMIT = 100
SCHEMA = "feature string, correlation double"


def index_target(df: DataFrame, target: str, small_limit: int = SMALL_INDEX) -> DataFrame:
    """A string target replaced by its frequency rank (0.0 is the largest class, ties alphabetical), as last column.

    Rows without a target are dropped. A target that is not a string is left as it is.
    """
    require(df, target)
    if not is_string(df.schema[target]):
        return df
    index = frequency_index(df, target, small_limit)
    rest = [ref(c) for c in df.columns if c != target]
    return index.attach(df, ref(target), "__index").select(*rest, F.col("__index").alias(target))


def target_correlation(
    df: DataFrame, target: str, limit: int = CATEGORY_LIMIT, complete_cases: bool = False
) -> DataFrame:
    """Pearson correlation of each feature with the target, 3 decimals, strongest positive first.

    Numeric features are taken as they are, string features with fewer than ``limit`` distinct values by frequency
    rank, a string target likewise. Each pair uses the rows where both are present; ``complete_cases`` restricts all
    pairs to the rows where every ranked column is present. Constant features are left out.
    """
    require(df, target)
    field = df.schema[target]
    numeric, strings = numeric_columns(df, [target]), string_columns(df, [target])
    if not (is_numeric(field) or is_string(field)):
        return empty(df, SCHEMA)
    if complete_cases:
        ranked = _low_cardinality(df, strings, limit)
        needed = ranked + ([target] if is_string(field) else [])
        df = df.filter(reduce(and_, [ref(c).isNotNull() for c in needed], F.lit(True)))
    y = ref(target).cast("double")
    if is_string(field):
        # rows without a label stay: they count in the ranks of the features
        df, y = frequency_index(df, target).attach(df, ref(target), "__y", keep_null=True), F.col("__y")
    centre, *found = aggregate_row(df, [F.avg(y)] + [pearson(ref(c).cast("double"), y) for c in numeric])
    rows = [(c, r) for c, r in zip(numeric, found) if r is not None]
    result = local_rows(df.sparkSession, rows, SCHEMA)
    few = _low_cardinality(df, strings, limit)
    if few and centre is not None:
        result = result.unionByName(_ranked_correlation(df, few, y - F.lit(centre), limit))
    return (
        result.select("feature", F.round("correlation", 3).alias("correlation"))
        .orderBy(F.isnan("correlation"), F.desc("correlation"), "feature")
    )


def _low_cardinality(df: DataFrame, names: list[str], limit: int) -> list[str]:
    """The columns with fewer than ``limit`` values, NULL being one, by exact counts from one frequency table."""
    if not names:
        return []
    sizes = {r["column"]: r["n_values"] for r in totals(frequencies(df, names, keep_values=False)).collect()}
    return [c for c in names if sizes[c] < limit]


def _ranked_correlation(df: DataFrame, names: list[str], y, limit: int) -> DataFrame:
    """Correlation of the frequency ranks of string columns with ``y``, from per-value sums in one scan.

    The rank of a value is known only after counting, but it is constant within the value, so sums per value are
    enough. ``y`` is centred, which keeps the differences of squares accurate.
    """
    flat = df.select(y.alias("__y"), *[ref(c) for c in names])
    long = flat.unpivot([F.col("__y")], [ref(c) for c in names], "feature", "value")
    sums = long.groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("__y").alias("m"),
        F.coalesce(F.sum("__y"), F.lit(0.0)).alias("sy"),
        F.coalesce(F.sum(F.col("__y") * F.col("__y")), F.lit(0.0)).alias("syy"),
    )
    # fewer than limit values per feature
    by_feature = Window.partitionBy("feature")
    place = F.row_number().over(by_feature.orderBy(F.col("value").isNull(), F.desc("n"), "value"))
    ranked = (
        sums.select("*", (place - 1).cast("double").alias("x"), F.count(F.lit(1)).over(by_feature).alias("__k"))
        .filter((F.col("__k") < limit) & F.col("value").isNotNull())
    )
    x, m = F.col("x"), F.col("m")
    total = ranked.groupBy("feature").agg(
        F.sum("m").alias("m"), F.sum(x * m).alias("sx"), F.sum(x * x * m).alias("sxx"),
        F.sum("sy").alias("sy"), F.sum("syy").alias("syy"), F.sum(x * F.col("sy")).alias("sxy"),
    )
    size = F.nullif(F.col("m"), F.lit(0))

    def left_over(product, a, b):
        return F.col(product) - F.col(a) * F.col(b) / size

    spread = F.sqrt(F.greatest(left_over("sxx", "sx", "sx"), F.lit(0.0))) * F.sqrt(
        F.greatest(left_over("syy", "sy", "sy"), F.lit(0.0))
    )
    result = total.select("feature", (left_over("sxy", "sx", "sy") / F.nullif(spread, F.lit(0.0))).alias("correlation"))
    return result.filter(F.col("correlation").isNotNull())
