"""Rows that occur more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.columns import ref, require, string_columns
from scrubwell.functions.rows import repeated_keys, row_hash, with_canonical_maps, with_restored_maps


def _worth_hashing(df: DataFrame, names: Sequence[str]) -> bool:
    """Texts make the key wide; then a pass that shuffles only hashes pays for itself."""
    return bool(set(string_columns(df)) & set(names))


def duplicate_groups(
    df: DataFrame, target: str | None = None, columns: Sequence[str] | None = None, with_count: bool = True
) -> DataFrame:
    """One row per key that occurs more than once, with its number of rows in ``n_rows``.

    The key is ``columns``, or every column but ``target``. Maps are equal if they have equal entries, in whatever order.
    """
    require(df, target, *(columns or ()))
    names = list(columns) if columns else [c for c in df.columns if c != target]
    keyed = with_canonical_maps(df.select(*[ref(c) for c in names]))
    if _worth_hashing(df, names):
        repeated = repeated_keys(keyed, names)
        if repeated is not None:
            tagged = keyed.withColumn("__key", row_hash(names))
            keyed = tagged.join(F.broadcast(repeated), "__key", "left_semi").drop("__key")
    grouped = keyed.groupBy(*[ref(c) for c in names]).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    grouped = with_restored_maps(grouped, df.schema)
    return grouped.withColumnRenamed("__n", "n_rows") if with_count else grouped.drop("__n")


def drop_duplicates(df: DataFrame, target: str | None = None) -> DataFrame:
    """Exact duplicates over all columns removed; with a ``target``, that column comes last.

    In tables with text, rows whose hash is unique pass without a shuffle and only the others are compared, as long
    as the repeated hashes are few enough to broadcast. Otherwise all rows are grouped.
    """
    require(df, target)
    names = [c for c in df.columns if c != target] + ([target] if target is not None else [])
    whole = df.select(*[ref(c) for c in names])
    return with_restored_maps(_distinct_rows(with_canonical_maps(whole), names), whole.schema)


def _distinct_rows(df: DataFrame, names: list[str]) -> DataFrame:
    if not _worth_hashing(df, names):
        return df.dropDuplicates()
    repeated = repeated_keys(df, names)
    if repeated is None:
        return df.dropDuplicates()
    tagged = df.withColumn("__key", row_hash(names))
    single = tagged.join(F.broadcast(repeated), "__key", "left_anti").drop("__key")
    several = tagged.join(F.broadcast(repeated), "__key", "left_semi").drop("__key").dropDuplicates()
    return single.unionByName(several)
