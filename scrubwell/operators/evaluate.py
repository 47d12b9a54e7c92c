"""Train models on a table, score them, and compare a table before and after cleaning."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.columns import local_rows, ref, require, string_columns
from scrubwell.functions.rows import content_digest
from scrubwell.operators.features import TASKS, TEXT_CHARS, fit_features, label_index, prepare_rows, text_features
from scrubwell.operators.metrics import classification_metrics, regression_metrics
from scrubwell.operators.resample import SEED, TRAIN_PERCENT, split_point
from scrubwell.operators.timestamps import timestamp_features
from scrubwell.operators.words import fit_naive_bayes
from scrubwell.plans.cleaning import CleaningPlan

METRICS = {
    "regression": ("rmse", "mse"),
    "classification": ("accuracy", "f1", "precision", "recall"),
    "text_classification": ("accuracy", "f1", "precision", "recall"),
}


def models(task: str, bins: int, tree_column: str = "features") -> dict[str, object]:
    """The models of a task. Trees get as many bins as the richest category needs, and read ``tree_column``. The text task
    has a function that learns from tables."""
    if task == "regression":
        return {
            "Linear Regression": LinearRegression(),
            "Decision Tree": DecisionTreeRegressor(maxBins=bins, featuresCol=tree_column),
            "Random Forest": RandomForestRegressor(maxBins=bins, seed=SEED, featuresCol=tree_column),
        }
    if task == "classification":
        return {
            "Logistic Regression": LogisticRegression(maxIter=10),
            "Decision Tree": DecisionTreeClassifier(maxBins=bins, featuresCol=tree_column),
            "Random Forest": RandomForestClassifier(numTrees=20, maxBins=bins, seed=SEED, featuresCol=tree_column),
        }
    if task == "text_classification":
        return {"Naive Bayes": fit_naive_bayes}
    raise ValueError(f"unknown task {task!r}, expected one of {', '.join(TASKS)}")


# Rows and bytes of strings of a partition while models are fitted, and the fewest partitions. Bagging in a forest follows
# the partitions, so their number must come from the table and not from the machine.
PARTITION_ROWS = 100_000
PARTITION_BYTES = 32 << 20
PARTITIONS = 8
COUNTS = ("n_train", "n_test", "n_scored", "n_features")
# Signs of a failing cluster in an error. Such an error says nothing about the model and is passed on.
CLUSTER_FAILURES = (
    "ExecutorLostFailure", "OutOfMemoryError", "FetchFailed", "No space left", "java.io.IOException", "shut down", "cancelled",
)


def result_schema(task: str) -> str:
    return (
        "model string, status string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", "
        + ", ".join(f"{m} double" for m in METRICS[task]) + ", error string"
    )


def _reason(error: Exception) -> str:
    """The first line of an error of the model or its input; an error of the cluster is raised again."""
    if any(sign in str(error) for sign in CLUSTER_FAILURES):
        raise error
    lines = str(error).strip().splitlines()
    return lines[0] if lines else type(error).__name__


def evaluate(
    df: DataFrame,
    target: str,
    task: str,
    seed: int = SEED,
    train_percent: int = TRAIN_PERCENT,
    text_chars: float = TEXT_CHARS,
    train_steps: CleaningPlan | None = None,
    inverse: Callable[[Column], Column] | None = None,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Fit every model of the task on the training rows and score it on the test rows, a row per model.

    Features are fitted once and shared by the models, which read them from a persisted table. ``train_steps`` are
    cleaning steps for the training rows alone, ``inverse`` maps labels and predictions back to the scale in which a
    regression is to be scored, ``only`` names the models to fit. Beside the metrics stand the numbers of rows trained on,
    set apart for the test, and scored, and the length of the feature vector. Linear models cannot score test rows with a
    string that no training row has; trees and naive Bayes score all but those with such a label. A model
    that fails, or scores no row, gives a row with ``status`` "failed" and the first line of the error. Lost executors and
    full disks are no property of a model: such errors are raised.
    """
    rows = _evaluate_rows(df, target, task, seed, train_percent, text_chars, train_steps, inverse, only)
    return local_rows(df.sparkSession, rows, result_schema(task))


def _evaluate_rows(
    df, target, task, seed, train_percent, text_chars, train_steps, inverse, only=None
) -> list[tuple]:
    require(df, target)
    names = [name for name in models(task, 2) if only is None or name in only]
    if only is not None and len(names) != len(set(only)):
        raise ValueError(f"the models of {task} are {list(models(task, 2))}, not all of {list(only)}")
    metrics = METRICS[task]
    blank = (None,) * len(metrics)
    held = []

    def hold(part: DataFrame) -> DataFrame:
        """Kept for the passes below, of which fits make many; lost blocks are computed again."""
        held.append(part.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    try:
        prepared = prepare_rows(df, target, task)
        columns = [ref(c) for c in prepared.columns]
        digest = content_digest(prepared, prepared.columns, seed)
        marked = prepared.select(*columns, digest.alias("__digest"), split_point(prepared, seed).alias("__point"))
        parts = _partitions(marked, string_columns(prepared))
        # Rows are dealt and sorted by content, so a row gets the same number when its partition is made again.
        marked = marked.repartition(parts, "__digest").sortWithinPartitions("__digest")
        marked = hold(marked.withColumn("__row", F.monotonically_increasing_id()))
        train = marked.filter(F.col("__point") < train_percent).select(*columns)
        test = marked.filter(F.col("__point") >= train_percent).select(*columns, "__row")
        n_test = test.count()
        if train_steps is not None:
            train = hold(train_steps.apply(train))
        if task == "text_classification":
            return [(name, *_evaluate_words(train, test, target, n_test)) for name in names]
        try:
            texts = (
                text_features(marked, string_columns(prepared, [target]), text_chars)
                if task == "classification" else None
            )
            features = fit_features(train, target, task, texts)
            train, test = hold(features.transform(train)), hold(features.transform(test))
            n_train = train.count()
        except Exception as error:
            reason = _reason(error)
            return [(name, "failed", None, n_test, None, None, *blank, reason) for name in names]
        rows = []
        fresh = models(task, features.max_bins, features.tree_column)
        for name in names:
            column = fresh[name].getFeaturesCol()
            known = test.filter(F.col(column).isNotNull())
            shown = (n_train, n_test, known.count(), features.slots[column])
            try:
                scored = fresh[name].fit(train).transform(known).select("label", "prediction")
                if shown[2] == 0:
                    raise ValueError("no test row could be scored")
                if task == "regression":
                    if inverse is not None:
                        scored = scored.select(*[inverse(F.col(c)).alias(c) for c in scored.columns])
                    values = regression_metrics(scored).first()
                else:
                    values = classification_metrics(scored).first()
                rows.append((name, "ok", *shown, *values, None))
            except Exception as error:
                rows.append((name, "failed", *shown, *blank, _reason(error)))
        return rows
    finally:
        for part in held:
            part.unpersist()


def _partitions(df: DataFrame, strings: Sequence[str]) -> int:
    """How many partitions the rows are dealt into: ``PARTITION_ROWS`` rows and ``PARTITION_BYTES`` bytes of strings at most
    each, so that long texts do not make a task read more; ``PARTITIONS`` at least."""
    size = sum([F.coalesce(F.octet_length(ref(c)), F.lit(0)).cast("bigint") for c in strings], F.lit(0).cast("bigint"))
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return max(PARTITIONS, -(-rows // PARTITION_ROWS), -(-total // PARTITION_BYTES))


def _evaluate_words(train: DataFrame, test: DataFrame, target: str, n_test: int) -> tuple:
    """A result without the name: naive Bayes from the word statistics of the training rows."""
    blank = (None,) * len(METRICS["text_classification"])
    n_train = n_scored = n_features = None
    try:
        names = [c for c in train.columns if c != target]
        labels = label_index(train, target)

        def labelled(df: DataFrame) -> DataFrame:
            if labels:
                return labels.attach(df, ref(target), "__label")
            return df.withColumn("__label", ref(target).cast("double"))

        ready, n_train = labelled(train), train.count()
        model = fit_naive_bayes(ready, names, "__label")
        n_features = model.statistics.n_features
        known = labelled(test)
        n_scored = known.count()
        if n_scored == 0:
            raise ValueError("no test row could be scored")
        scored = model.predict(known, label="__label").select(F.col("__label").alias("label"), "prediction")
        return ("ok", n_train, n_test, n_scored, n_features, *classification_metrics(scored).first(), None)
    except Exception as error:
        return ("failed", n_train, n_test, n_scored, n_features, *blank, _reason(error))


def compare(
    raw: DataFrame,
    cleaned: DataFrame | CleaningPlan,
    target: str,
    task: str,
    original_scale: bool = False,
    **options,
) -> DataFrame:
    """The models of the task on the raw and on the cleaned table, a row per version and model.

    ``cleaned`` is a table, or a plan to run on ``raw``. Steps of a plan that are marked for training rows are run
    after the split, so no copy they make is tested on. ``<metric>_change`` is the difference to the raw table. With
    ``original_scale`` a target that the plan transformed is scored in its own unit. The classification task adds
    the calendar parts of timestamps to both versions.
    """
    train_steps, inverse = None, None
    if isinstance(cleaned, CleaningPlan):
        done = cleaned.before_split().run(raw)
        cleaned_rows, train_steps = done.table, cleaned.for_training()
        if original_scale:
            inverse = done.inverse_of(target)
    elif original_scale:
        raise ValueError("original_scale needs the plan, a table does not tell how its target was transformed")
    else:
        cleaned_rows = cleaned
    if task == "classification":
        raw, cleaned_rows = timestamp_features(raw), timestamp_features(cleaned_rows)
    settings = {"seed": SEED, "train_percent": TRAIN_PERCENT, "text_chars": TEXT_CHARS, **options}
    before = _evaluate_rows(raw, target, task, train_steps=None, inverse=None, **settings)
    after = _evaluate_rows(cleaned_rows, target, task, train_steps=train_steps, inverse=inverse, **settings)
    names = METRICS[task]
    first = 2 + len(COUNTS)
    base = {row[0]: row[first:-1] for row in before}
    rows = []
    for version, found in (("raw", before), ("cleaned", after)):
        for row in found:
            values = row[first:-1]
            changes = tuple(
                round(v - b, 3) if version == "cleaned" and v is not None and b is not None else None
                for v, b in zip(values, base[row[0]])
            )
            rows.append((version, *row[:-1], *changes, row[-1]))
    schema = (
        "version string, model string, status string, "
        + ", ".join(f"{c} bigint" for c in COUNTS) + ", "
        + ", ".join(f"{m} double" for m in names) + ", "
        + ", ".join(f"{m}_change double" for m in names) + ", error string"
    )
    return local_rows(raw.sparkSession, rows, schema)
