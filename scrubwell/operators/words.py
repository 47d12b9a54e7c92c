"""Word statistics as tables: document frequencies, TF-IDF weights, sums per class, and naive Bayes scored from them.

A table of entries says of each row which features it has: the words of a text column, each time they occur, and a number
of a numeric column once. Statistics are grouped sums over entries, so neither vocabulary nor vectors are ever gathered;
rows are scored by joining their entries with the statistics and adding up. Words travel as 128-bit digests.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.columns import is_numeric, is_string, ref
from scrubwell.functions.indexing import running_totals, value_key
from scrubwell.functions.rows import content_digest
from scrubwell.functions.storage import cut_lineage

# Entries for the words on most rows are joined by broadcast, up to this many bytes together; the rest by shuffle.
HOT_BYTES = 2 << 20
# What an entry takes without its classes, and for each class.
ENTRY_BYTES, CLASS_BYTES = 80, 16
# Bins per doubling of a row count, by which the words to be broadcast are chosen.
STEPS = 8
# Tables up to this many words are put in order by one task.
SMALL = 100_000
# Fixed value of naive Bayes: what is added to every count.
SMOOTHING = 1.0


def words(text: Column) -> Column:
    """The words of a text in lower case: what stands between single blanks, empty words but not those at the end."""
    lower = F.lower(text)
    rest = F.rtrim(lower, F.lit(" \t\n\x0b\f\r"))
    none = F.array().cast("array<string>")
    return F.when((rest == "") & (lower != ""), none).otherwise(F.split(rest, r"\s"))


def _entries(df: DataFrame, names: Sequence[str], keep: dict[str, Column], held: bool = False) -> DataFrame:
    """The columns ``keep`` with all entries of a row, a line each: ``__column``, ``__word``, ``__weight`` and ``__holders``. With
    ``held`` the first of equal words counts as a holder; as sums are taken, it may stand apart from its weight."""
    kept = [c.alias(n) for n, c in keep.items()]

    def lines(j: int, word: Column, weight: Column, holders: int) -> DataFrame:
        return df.select(*kept, F.lit(j).alias("__column"), word.alias("__word"), weight.alias("__weight"), F.lit(holders).alias("__holders"))

    parts = []
    for j, name in enumerate(names):
        if is_string(df.schema[name]):
            own = words(ref(name))
            parts.append(lines(j, F.explode(own), F.lit(1.0), 0))
            if held:
                parts.append(lines(j, F.explode(F.array_distinct(own)), F.lit(0.0), 1))
        else:
            parts.append(lines(j, F.lit(""), ref(name).cast("double"), 1))
    return reduce(DataFrame.union, parts)


@dataclass(frozen=True)
class WordStatistics:
    """``table`` holds a row per feature: ``__column`` (its place in ``names``), ``__key`` (digest of the word), ``__word``,
    ``__tokens`` (sum of weights), ``__holders`` (rows that have it), ``__idf``, ``__classes`` (class and sum of weights)."""

    table: DataFrame
    names: tuple[str, ...]
    n_features: int
    wide: bool
    hot_floor: int

    def look_up(self, entries: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """``entries`` (with ``__column`` and ``__word``) of known features, with columns made from the table."""
        on = ["__column", "__key"]
        keyed = entries.withColumn("__key", value_key(F.col("__word"), self.wide)).drop("__word")
        table = self.table.select(*on, F.floor(F.log2("__holders") * STEPS).alias("__step"), *[c.alias(n) for n, c in columns.items()])
        hot = table.filter(F.col("__step") >= self.hot_floor).drop("__step")
        often = keyed.join(F.broadcast(hot), on)
        if self.hot_floor == 0:
            return often.drop("__key")
        cold = table.filter(F.col("__step") < self.hot_floor).drop("__step")
        seldom = keyed.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
        return often.unionByName(seldom).drop("__key")

    @cached_property
    def numbered(self) -> WordStatistics:
        """The statistics with ``__slot``: features of one column stand together, the most frequent word first, ties by word."""
        order = [F.asc("__column"), F.desc("__tokens"), F.asc("__word")]
        placed = running_totals(self.table, order, F.lit(1).cast("bigint"), self.n_features <= SMALL, self.n_features)
        table = cut_lineage(placed.withColumnRenamed("__before", "__slot"))
        return WordStatistics(table, self.names, self.n_features, self.wide, self.hot_floor)

    def vectors(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The columns ``keep`` of each row, and ``features``: its weights as an array of ``(slot, weight)`` by slot.

        Equal rows have equal vectors, so one of them is weighed, however many there are.
        """
        keyed = df.select(*[ref(c) for c in dict.fromkeys([*keep, *self.names])])
        keyed = keyed.withColumn("__row", F.unhex(content_digest(keyed, self.names, "row")))
        once = keyed.dropDuplicates(["__row"])
        entries = _entries(once, self.names, {"__row": F.col("__row")}).groupBy("__row", "__column", "__word").agg(F.sum("__weight").alias("__weight"))
        found = self.numbered.look_up(entries, {"slot": F.col("__slot"), "__idf": F.col("__idf")})
        cell = F.struct("slot", (F.col("__weight") * F.col("__idf")).alias("weight"))
        vectors = found.groupBy("__row").agg(F.sort_array(F.collect_list(cell)).alias("features"))
        none = F.array().cast(vectors.schema["features"].dataType)
        return keyed.join(vectors, "__row", "left").select(*[ref(c) for c in keep], F.coalesce("features", none).alias("features"))


def word_statistics(train: DataFrame, names: Sequence[str], class_column: str | None = None) -> WordStatistics:
    """Statistics of the string and numeric columns ``names`` over all rows, by class if there is a column of it.

    A word weighs ``ln((rows + 1) / (rows that have it + 1))`` per occurrence, a number 1 per unit. Rows are read once:
    entries are added up per class and word before they are shuffled.
    """
    other = [n for n in names if not (is_string(train.schema[n]) or is_numeric(train.schema[n]))]
    if not names:
        raise ValueError("there is no column to learn from")
    if other:
        raise ValueError(f"only strings and numbers have a weight, not {other}")
    label = F.lit(None).cast("double") if class_column is None else ref(class_column)
    entries = _entries(train, names, {"__class": label}, held=True)
    summed = entries.groupBy("__column", "__word", "__class").agg(
        F.sum("__weight").alias("__weight"), F.sum("__holders").alias("__holders"), F.min("__weight").alias("__least")
    )
    of_classes = F.collect_list(F.struct("__class", "__weight")).alias("__classes")  # as many as classes
    table = summed.groupBy("__column", "__word").agg(
        F.sum("__weight").alias("__tokens"), F.sum("__holders").alias("__holders"), F.min("__least").alias("__least"), of_classes
    )
    documents = train.count()
    numeric = [j for j, n in enumerate(names) if not is_string(train.schema[n])]
    idf = F.log((F.lit(documents) + 1) / (F.col("__holders") + 1))
    table = cut_lineage(table.withColumn("__idf", F.when(F.col("__column").isin(numeric), 1.0).otherwise(idf) if numeric else idf))
    key = value_key(F.col("__word"))
    size, keys = table.agg(F.count(F.lit(1)), F.count_distinct("__column", key)).first()
    if low := table.filter((F.col("__least") < 0) | F.isnan("__least")).select("__column").first():
        raise ValueError(f"naive Bayes weighs amounts, and column {names[low[0]]!r} has values below 0")
    wide = keys < size
    return WordStatistics(table.withColumn("__key", value_key(F.col("__word"), wide)), tuple(names), size, wide, _hot_floor(table))


def _hot_floor(table: DataFrame, most: int | None = None) -> int:
    """The step of row counts from which on the entries together take at most ``HOT_BYTES``."""
    width = F.sum(F.lit(ENTRY_BYTES) + F.lit(CLASS_BYTES) * F.size("__classes"))
    steps = table.groupBy(F.floor(F.log2("__holders") * STEPS).alias("step")).agg(width.alias("bytes"))
    held, floor = 0, 64 * STEPS
    for row in sorted(steps.collect(), reverse=True):  # a row per step, 8 for each doubling
        held += row["bytes"]
        if held > (HOT_BYTES if most is None else most):
            return floor
        floor = row["step"]
    return 0


@dataclass(frozen=True)
class NaiveBayes:
    """Multinomial naive Bayes: ``classes`` holds label, logarithm of the share, and logarithm of the weight, per class."""

    statistics: WordStatistics
    classes: list[tuple[float, float, float]]

    def predict(self, df: DataFrame, row: str = "__row", label: str = "label") -> DataFrame:
        """``row``, ``label`` and ``prediction`` of each row, which its number ``row`` names. Of classes that score alike the
        first is predicted; words that training has not seen count for none."""
        entries = _entries(df, self.statistics.names, {"__at": ref(row), "__label": ref(label)})
        weight = F.col("__idf")
        # A word's gain for each class that has it, and under no class what all lose by the length of their words.
        gains = F.transform("__classes", lambda c: F.struct(c["__class"].alias("__class"), (weight * F.log(c["__weight"] * weight + SMOOTHING)).alias("__v")))
        all_classes = F.struct(F.lit(None).cast("double").alias("__class"), weight.alias("__v"))
        known = self.statistics.look_up(entries, {"__gains": F.concat(F.array(all_classes), gains)})
        found = known.select("__at", "__label", "__weight", F.inline("__gains"))
        found = found.select("__at", "__label", "__class", (F.col("__v") * F.col("__weight")).alias("__v"))
        every = df.select(ref(row).alias("__at"), ref(label).alias("__label"), F.lit(None).cast("double").alias("__class"), F.lit(0.0).alias("__v"))
        sums = found.unionByName(every).groupBy("__at", "__label", "__class").agg(F.sum("__v").alias("__v"))
        own = F.map_from_entries(F.collect_list(F.when(F.col("__class").isNotNull(), F.struct("__class", "__v"))))
        rows = sums.groupBy("__at", "__label").agg(F.max(F.when(F.col("__class").isNull(), F.col("__v"))).alias("__all"), own.alias("__own"))
        learned = [{"label": c, "share": s, "weight": w} for c, s, w in self.classes]
        learned = F.from_json(F.lit(json.dumps(learned)), "array<struct<label:double,share:double,weight:double>>")
        gain = lambda c: F.coalesce(F.try_element_at("__own", c["label"]), F.lit(0.0))
        score = F.transform(learned, lambda c: F.struct((c["share"] + gain(c) - c["weight"] * F.col("__all")).alias("score"), (-c["label"]).alias("last")))
        best = (F.lit(0.0) - F.array_max(score)["last"]).alias("prediction")
        return rows.select(F.col("__at").alias(row), F.col("__label").alias(label), best)


def fit_naive_bayes(train: DataFrame, names: Sequence[str], label: str = "label") -> NaiveBayes:
    """Learn from the columns ``names`` and the numeric classes in ``label``. The driver holds three numbers per class."""
    statistics = word_statistics(train, names, label)
    sizes = {r[0]: r[1] for r in train.groupBy(ref(label)).agg(F.count(F.lit(1))).collect()}
    cells = statistics.table.select("__idf", F.inline("__classes"))
    sums = {r[0]: r[1] for r in cells.groupBy("__class").agg(F.sum(F.col("__idf") * F.col("__weight"))).collect()}
    rows = sum(sizes.values())
    share = lambda n: math.log(n + SMOOTHING) - math.log(rows + SMOOTHING * len(sizes))
    weight = lambda c: math.log(sums.get(c, 0.0) + SMOOTHING * max(statistics.n_features, 1))
    return NaiveBayes(statistics, [(c, share(n), weight(c)) for c, n in sorted(sizes.items())])
