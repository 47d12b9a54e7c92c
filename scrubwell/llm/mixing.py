"""Mixing sources to target weights along a curriculum, in Spark expressions only.

Every source has a weight schedule: a piecewise linear weight over training progress 0..1. Its integral is the source's
weight in the whole mix. Shares of the budget follow the weights, but no source is repeated more than ``repeats`` times;
what that frees goes to the others by weight. A source's documents, in an order given by a digest and repeated as often
as needed, form its stream of words. A copy whose middle lies at word *d* of the stream stands at the progress where the
schedule's integral reaches the fraction *d / target*: the cumulative demand, inverted. Copies are range-sorted by it.

NULL is a source like any other, last in order. NULL and empty texts have size 0: they follow their source's copies but
take no words. Rows that share an id are ordered by size; equal rows are interchangeable. A table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubwell.functions.storage import cut_lineage
from scrubwell.llm.words import count_words


@dataclass(frozen=True)
class Schedule:
    """Weights at increasing progress, from 0 to 1, linear in between; not negative, positive somewhere."""

    knots: tuple[tuple[float, float], ...]

    def segments(self) -> Column:
        """Per stretch between knots: begin, end, weight at the begin, slope, integral before it."""
        out, area = [], 0.0
        for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:], strict=False):
            values = {"t0": t0, "t1": t1, "w0": w0, "slope": (w1 - w0) / (t1 - t0), "before": area}
            out.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in values.items()]))
            area += (t1 - t0) * (w0 + w1) / 2
        return F.array(*out)

    @property
    def weight(self) -> float:
        return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:], strict=False))


# The first kind of source is learned from early, the second grows, the third enters half way. Integrals: 5, 2, 1.
CURRICULUM = (
    Schedule(((0.0, 7.0), (1.0, 3.0))),
    Schedule(((0.0, 1.0), (0.5, 2.0), (1.0, 3.0))),
    Schedule(((0.0, 0.5), (0.5, 0.5), (1.0, 2.5))),
)
# A source's stream is cut into so many stretches by digest, which are summed and ordered independently.
STRETCH_DIGITS = 3


def _progress(share: Column, segments: Column, weight: Column) -> Column:
    """Where the schedule's integral reaches ``share`` of the whole: a quadratic per segment, solved without cancellation."""
    area = share * weight
    at = F.element_at(F.filter(segments, lambda s: (s["before"] <= area) | (s["t0"] == 0.0)), -1)
    left = F.greatest(area - at["before"], F.lit(0.0))
    root = at["w0"] + F.sqrt(F.greatest(at["w0"] * at["w0"] + F.lit(2.0) * at["slope"] * left, F.lit(0.0)))
    return F.least(at["t0"] + F.when(root > 0, F.lit(2.0) * left / root).otherwise(F.lit(0.0)), at["t1"])


def _targets(sizes: DataFrame, curriculum: Sequence[Schedule], repeats: int, budget: int | None) -> DataFrame:
    """Per source: its size, target, weight and segments. ``sizes`` has a row per source, of which mixes have few."""
    ranked = sizes.withColumn("kind", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(curriculum))
    pick = lambda values: F.element_at(F.array(*values), F.col("kind") + 1)
    weighed = ranked.select(
        "*", pick([F.lit(float(s.weight)) for s in curriculum]).alias("weight"), pick([s.segments() for s in curriculum]).alias("segments"),
        (F.col("source_size") * repeats).alias("most"),
    )
    # The level at which least(most, level * weight) fills the budget: the largest level over the prefixes of full sources.
    whole = Window.partitionBy()
    by_need = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("most").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(whole) if budget is None else F.lit(budget)
    levels = weighed.withColumn("level", (total - full).cast("double") / open_weight)
    level = F.max("level").over(whole)
    target = F.least(F.col("most").cast("double"), level * F.col("weight"))
    return levels.withColumn("target", target).select("key", "source_size", "target", "weight", "segments")


def mixing_plan(
    docs: DataFrame, curriculum: Sequence[Schedule] = CURRICULUM, repeats: int = 3, budget: int | None = None, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] | None = None,
) -> DataFrame:
    """Each document with what the mix does with it.

    Schedules go to the sources in code point order, over and over. Columns: ``row`` (the document's columns, or those
    in ``keep``, which alone are shuffled), ``size``
    (words), ``source_size``, ``target`` (words of its source), ``copies``, ``taken`` (copies times size), ``positions``
    (progress of each copy) and ``place``, the digest that orders a source.

    Two passes: sums by source and stretch (partial sums before the shuffle), then running sums inside each stretch, so a
    source with most rows is the work of thousands of independent groups. The last repetition takes the documents
    whose middle lies before the target, so the words taken differ from it by half a document at most.
    """
    source, doc_id = docs[source_col].cast("string"), docs[id_col]
    place = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    sized = docs.select(
        F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"), source.alias("source"), count_words(docs[text_col].cast("string")).alias("size"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("key"), place.alias("place"), F.substring(place, 1, STRETCH_DIGITS).alias("stretch"),
    )
    sums = cut_lineage(sized.groupBy("key", "source", "stretch").agg(F.sum("size").alias("words")))
    targets = _targets(sums.groupBy("key", "source").agg(F.sum("words").alias("source_size")), curriculum, repeats, budget)
    before = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "stretch", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("stretch_start"))
    inside = Window.partitionBy("key", "stretch").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.drop("source").withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts.join(targets, "key"), ["key", "stretch"])
    middle = F.col("stretch_start") + F.col("inside") + F.col("size") / F.lit(2.0)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - rounds * F.col("source_size")
    copies = (rounds + F.when(middle < rest, 1).otherwise(0)).cast("int")
    planned = placed.withColumns({"middle": middle, "copies": copies})
    share = lambda i: (i * F.col("source_size") + F.col("middle")) / F.col("target")
    numbers = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    positions = F.transform(numbers, lambda i: _progress(share(i), F.col("segments"), F.col("weight")))
    return planned.select(
        "row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), positions.alias("positions"), "place"
    )


def mix(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row per copy, range-sorted by training position.

    Whole documents are shuffled twice: to their stretch, and to their position.
    """
    planned = mixing_plan(docs, **options).filter(F.col("copies") > 0)
    copies = planned.select("row", "place", F.explode("positions").alias("position"))
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartitionByRange(parts, "position", "place").sortWithinPartitions("position", "place").select("row.*")
