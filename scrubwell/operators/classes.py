"""Class sizes and their balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.columns import ref, require

# Fixed value: the largest class may be this many times the smallest before the classes count as unbalanced.
IMBALANCE_RATIO = 1.5


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """``(class, n)``, NULL being a class."""
    require(df, target)
    return df.groupBy(ref(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_imbalance(df: DataFrame, target: str, ratio: float = IMBALANCE_RATIO) -> DataFrame:
    """One row: number of classes, size of the smallest and largest, and whether they differ too much."""
    sizes = class_distribution(df, target)
    return sizes.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
        F.coalesce(F.max("n") > ratio * F.min("n"), F.lit(False)).alias("imbalanced"),
    )


def is_imbalanced(df: DataFrame, target: str, ratio: float = IMBALANCE_RATIO) -> bool:
    return class_imbalance(df, target, ratio).first()["imbalanced"]
