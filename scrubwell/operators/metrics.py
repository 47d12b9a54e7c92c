"""Scores of predictions, each from a single aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.columns import ref


def regression_metrics(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row: ``rmse`` and ``mse``, 3 decimals."""
    error = ref(label).cast("double") - ref(prediction).cast("double")
    mse = F.avg(error * error)
    return predictions.agg(F.round(F.sqrt(mse), 3).alias("rmse"), F.round(mse, 3).alias("mse"))


def confusion_counts(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)``."""
    return predictions.groupBy(
        ref(label).cast("double").alias("label"), ref(prediction).cast("double").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row of percentages, 2 decimals: accuracy, and F1, precision and recall weighted by class size.

    All come from the confusion counts: each count is one line for its true class and one for the predicted class.
    """
    counts = confusion_counts(predictions, label, prediction)
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)

    def line(name: str, actual: Column, predicted: Column, correct: Column) -> Column:
        return F.struct(
            F.col(name).alias("class"), actual.alias("actual"), predicted.alias("predicted"), correct.alias("correct")
        )

    lines = F.array(
        line("label", F.col("n"), zero, hit),
        line("prediction", zero, F.col("n"), zero),
    )
    classes = (
        counts.select(F.inline(lines))
        .groupBy("class")
        .agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("correct").alias("correct"))
    )
    precision = F.coalesce(F.try_divide("correct", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("correct", "actual"), F.lit(0.0))
    scored = classes.select("actual", "correct", precision.alias("p"), recall.alias("r"))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))

    def percent(weighted: Column) -> Column:
        return F.round(100 * F.try_divide(F.sum(weighted), F.sum("actual")), 2)

    return scored.agg(
        percent(F.col("correct")).alias("accuracy"),
        percent(f1 * F.col("actual")).alias("f1"),
        percent(F.col("p") * F.col("actual")).alias("precision"),
        percent(F.col("r") * F.col("actual")).alias("recall"),
    )
