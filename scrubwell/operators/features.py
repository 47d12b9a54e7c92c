"""From a table to feature vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Tokenizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubwell.functions.columns import aggregate_row, is_string, numeric_columns, ref, require, string_columns
from scrubwell.functions.frequencies import categorical_summary
from scrubwell.functions.indexing import BINS, FrequencyIndex, dictionaries, frequency_index
from scrubwell.operators.missing import fill_columns
from scrubwell.operators.timestamps import expand_dates
from scrubwell.operators.words import word_statistics

TASKS = ("regression", "classification", "text_classification")
# Fills, the mean length above which a string counts as text, and the smallest number of categories
# that decides the bins of a tree.
MISSING_TEXT = "missing"
MISSING_NUMBER = {"regression": -1, "classification": -1, "text_classification": 0}
TEXT_CHARS = 15
MIN_CATEGORIES = 32
# Slots of hashed words for trees, which hold each row as a number per slot: 16 kB a row and text column. Linear models
# read the sparse vector and keep the default width.
TREE_SLOTS = 4096


def prepare_rows(df: DataFrame, target: str, task: str) -> DataFrame:
    """Rows ready for features.

    Timestamps and dates become year, month and day; rows without a target go; strings without a value read
    ``missing``, numbers -1, or 0 in the text task; booleans become numbers, which are filled likewise.
    """
    require(df, target)
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}, expected one of {', '.join(TASKS)}")
    df = expand_dates(df, ("year", "month", "day"), exclude=(target,), drop=True)
    df = df.filter(ref(target).isNotNull())
    flags = {f.name: ref(f.name).cast("int") for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)}
    if flags:
        df = df.withColumns(flags)
    df = fill_columns(df, dict.fromkeys(string_columns(df), MISSING_TEXT))
    return fill_columns(df, dict.fromkeys(numeric_columns(df), MISSING_NUMBER[task]))


def max_bins(df: DataFrame, target: str) -> DataFrame:
    """One row: twice the number of values of the richest string column but the target, and 64 at least."""
    require(df, target)
    names = string_columns(df, [target])
    floor = F.lit(MIN_CATEGORIES).cast("bigint")
    widest = F.greatest(floor, F.coalesce(F.max("n_values"), floor))
    if not names:
        return df.sparkSession.range(1).select((floor * 2).alias("max_bins"))
    return categorical_summary(df, names).agg((widest * 2).alias("max_bins"))


def text_features(df: DataFrame, names: list[str], threshold: float = TEXT_CHARS) -> list[str]:
    """The string columns whose mean length in characters is above ``threshold``, from one scan."""
    lengths = aggregate_row(df, [F.avg(F.length(ref(c))) for c in names])
    return [c for c, n in zip(names, lengths) if n is not None and n > threshold]


@dataclass
class Features:
    """A fitted table-to-vector transformation. ``tree_column`` is the vector that trees are to read, ``slots`` the length of
    each vector."""

    transform: Callable[[DataFrame], DataFrame]
    max_bins: int
    kinds: dict[str, str] = field(default_factory=dict)
    tree_column: str = "features"
    slots: dict[str, int] = field(default_factory=dict)


def label_index(train: DataFrame, target: str) -> FrequencyIndex | None:
    """The numbers of a string target, the most frequent class being 0; a numeric target needs none."""
    return frequency_index(train, target) if is_string(train.schema[target]) else None


def fit_features(
    train: DataFrame,
    target: str,
    task: str,
    text_columns: list[str] | None = None,
) -> Features:
    """Fit on prepared training rows; the result maps prepared rows to ``(label, features)`` and often ``tree_features``.

    Regression numbers every string by frequency. Classification hashes the words of text columns, for trees once more
    into ``TREE_SLOTS`` slots, and numbers the other strings. Trees read the numbers of strings as bins, 64 at most, of
    values in the order of their mean target, or with more than two classes as that many categories; a value that the
    training rows lack has a bin of its own. ``features`` has no number for such a value and is NULL. The text task weighs
    the words of every string by TF-IDF; there ``features`` is an array of slots and weights. Rows with a string label that
    the training rows lack are dropped.
    """
    names = [c for c in train.columns if c != target]
    if task == "text_classification":
        return _fit_words(train, target, names)
    safe = {c: f"c{i}" for i, c in enumerate(names)}
    strings = [c for c in names if is_string(train.schema[c])]
    texts = []
    if task == "classification":
        texts = text_columns if text_columns is not None else text_features(train, strings)
    categories = [c for c in strings if c not in texts]
    labels = label_index(train, target)
    response, several = ref(target).cast("double"), False
    if task == "classification":
        response, several = _outside_largest_class(train, target)
    known = {c: d.binned(BINS) for c, d in dictionaries(train, categories, response).items()}

    inputs, tree_inputs, stages = [], [], []
    for c in names:
        s = safe[c]
        if c in texts:
            stages.append(Tokenizer(inputCol=s, outputCol=f"{s}_words"))
            stages.append(HashingTF(inputCol=f"{s}_words", outputCol=f"{s}_tf"))
            stages.append(HashingTF(inputCol=f"{s}_words", outputCol=f"{s}_few", numFeatures=TREE_SLOTS))
        inputs.append(f"{s}_tf" if c in texts else f"{s}_idx" if c in categories else s)
        tree_inputs.append(f"{s}_few" if c in texts else f"{s}_bin" if c in categories else s)
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    if tree_inputs != inputs:
        stages.append(VectorAssembler(inputCols=tree_inputs, outputCol="tree_features"))

    def plain(df: DataFrame) -> DataFrame:
        label = ref(target) if labels else ref(target).cast("double")
        base = df.select(*[ref(c).alias(safe[c]) for c in names], label.alias("y"))
        base = labels.attach(base, F.col("y"), "label") if labels else base.withColumnRenamed("y", "label")
        for c, dictionary in known.items():
            s = safe[c]
            base = dictionary.look_up(base, F.col(s), {f"{s}_idx": "__index", f"{s}_bin": "__bin"})
            unseen = float(min(dictionary.size, BINS)) if several else dictionary.unseen
            base = base.withColumn(f"{s}_bin", F.coalesce(f"{s}_bin", F.lit(unseen)))
        whole = reduce(and_, [F.col(f"{safe[c]}_idx").isNotNull() for c in categories], F.lit(True))
        return base.withColumn("__whole", whole).fillna(-1.0, [f"{safe[c]}_idx" for c in categories])

    model = Pipeline(stages=stages).fit(plain(train))
    widths = {s.getOutputCol(): s.getNumFeatures() for s in model.stages if isinstance(s, HashingTF)}
    arity = {f"{safe[c]}_idx": d.size for c, d in known.items()}
    bins = {f"{safe[c]}_bin": min(d.size, BINS) + 1 for c, d in known.items()} if several else {}
    described = {"features": _slots(inputs, widths, arity)}
    if tree_inputs != inputs:
        described["tree_features"] = _slots(tree_inputs, widths, bins)
    label = F.col("label")
    if labels and task == "classification":
        label = label.alias("label", metadata={"ml_attr": {"type": "nominal", "num_vals": labels.size}})

    def transform(df: DataFrame) -> DataFrame:
        ready = model.transform(plain(df))
        vectors = {c: F.col(c) for c in described}
        if categories:
            vectors["features"] = F.when(F.col("__whole"), F.col("features"))
        return ready.select(label, *[v.alias(c, metadata=described[c]) for c, v in vectors.items()])

    kinds = {c: "text" if c in texts else "category" if c in categories else "number" for c in names}
    widest = max([MIN_CATEGORIES, *(min(d.size, BINS) for d in known.values())])
    return Features(transform, 2 * widest, kinds, list(described)[-1], {c: d["ml_attr"]["num_attrs"] for c, d in described.items()})


def _outside_largest_class(train: DataFrame, target: str) -> tuple[Column, bool]:
    """1.0 on rows that are not of the largest class (the first by value of several), and whether there are more than two
    classes."""
    sizes = train.groupBy(ref(target).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    figures = sizes.agg(F.count(F.lit(1)), F.min(F.struct((-F.col("n")).alias("n"), "c"))["c"]).first()
    return (ref(target) != F.lit(figures[1])).cast("double"), figures[0] > 2


def _fit_words(train: DataFrame, target: str, names: list[str]) -> Features:
    """The features of the text task: TF-IDF of words, and numbers as they are."""
    labels = label_index(train, target)
    statistics = word_statistics(train, names)

    def transform(df: DataFrame) -> DataFrame:
        if labels:
            return labels.attach(statistics.vectors(df, [target]), ref(target), "label").select("label", "features")
        return statistics.vectors(df, [target]).select(ref(target).cast("double").alias("label"), "features")

    kinds = {c: "text" if is_string(train.schema[c]) else "number" for c in names}
    return Features(transform, 2 * MIN_CATEGORIES, kinds, "features", {"features": statistics.n_features})


def _slots(inputs: list[str], widths: dict[str, int], arity: dict[str, int]) -> dict:
    """Column metadata that says which vector slots are categories.

    The assembler describes each slot, which for hashed words is a quarter of a million entries that every later
    step would carry along; models need to know the categories only.
    """
    nominal, slot = [], 0
    for name in inputs:
        if name in arity:
            nominal.append({"type": "nominal", "idx": slot, "num_vals": arity[name]})
        slot += widths.get(name, 1)
    described = {"num_attrs": slot}
    if nominal:
        described["attrs"] = {"nominal": nominal}
    return {"ml_attr": described}
