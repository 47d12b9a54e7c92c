"""Balancing classes by repeating or leaving out rows, and the train/test split. All by content, none by position.

Rows are ordered by a digest of their cells. Every choice is a function of that order, so a result does not change
with the partitioning, and lost tasks can be run again. Equal rows are interchangeable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubwell.functions.columns import ref, require, require_groupable
from scrubwell.functions.rows import PIECE, content_digest, digest_number, repeat_rows
from scrubwell.functions.storage import cut_lineage

SEED = 42
# Hex digits of the digest that name a bucket: 65,536 buckets per class.
BUCKET_DIGITS = 4
# Classes are broadcast as a table up to this many; a target with more is joined by shuffle.
BROADCAST_CLASSES = 100_000
# Fixed values of the split: the share of training rows in percent.
TRAIN_PERCENT = 80


def _class_sizes(df: DataFrame, target: str) -> tuple[DataFrame, int, int, int]:
    sizes = df.groupBy(ref(target).alias("__class")).agg(F.count(F.lit(1)).alias("__size"))
    sizes = cut_lineage(sizes)
    count, smallest, largest = sizes.agg(F.count(F.lit(1)), F.min("__size"), F.max("__size")).first()
    return sizes, count, smallest or 0, largest or 0


def _join_classes(df: DataFrame, target: str, table: DataFrame, n_classes: int) -> DataFrame:
    if n_classes <= BROADCAST_CLASSES:
        table = F.broadcast(table)
    return df.join(table, ref(target).eqNullSafe(F.col("__class")))


def undersample(
    df: DataFrame, target: str, seed: int = SEED, key: Sequence[str] | None = None, piece: int = PIECE
) -> DataFrame:
    """Every class (NULL is one) cut to the size of the smallest, without replacement.

    Kept are the rows of each class with the smallest digests. The digest at which a class is cut is found from
    counts per bucket and then counts per digest inside one bucket, so the wide rows are only filtered, never
    shuffled or sorted. ``key`` names columns that identify a row; then the search reads no others.
    """
    require(df, target, *(key or ()))
    require_groupable(df, [target])
    columns = [ref(c) for c in df.columns]
    names = list(key) if key else df.columns
    digest = content_digest(df, names, seed)
    _, n_classes, quota, _ = _class_sizes(df, target)
    narrow = df.select(ref(target), digest.alias("__digest"))
    cuts = cut_lineage(_cut_digests(narrow, target, quota, n_classes))
    marked = _join_classes(df.withColumn("__digest", digest), target, cuts, n_classes)
    kept = marked.filter(
        (F.col("__digest") < F.col("__cut")) | ((F.col("__digest") == F.col("__cut")) & (F.col("__take") == F.col("__same")))
    ).select(*columns)
    divided = cuts.filter("__take < __same").limit(1).count() > 0
    if not divided:
        return kept
    if key:
        raise ValueError(f"{list(key)} does not identify rows; leave key out")
    # Some copies of one and the same row are kept and others are not: collapse them, then repeat as often as needed.
    same = marked.filter((F.col("__digest") == F.col("__cut")) & (F.col("__take") < F.col("__same")))
    one = same.select(*columns, "__take", "__digest").dropDuplicates()
    some = repeat_rows(one, F.col("__take"), [F.col("__digest")], piece=piece)
    return kept.unionByName(some.select(*columns))


def _cut_digests(narrow: DataFrame, target: str, quota: int, n_classes: int) -> DataFrame:
    """Per class: the digest of the quota-th row, how many rows share it, and how many of those belong to the quota."""
    bucket = F.substring("__digest", 1, BUCKET_DIGITS)

    def crossing(counts: DataFrame, by: str, left) -> DataFrame:
        upto = F.sum("__n").over(
            Window.partitionBy("__class").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        )
        running = counts.withColumn("__upto", upto)
        return running.filter((F.col("__upto") >= left) & (F.col("__upto") - F.col("__n") < left))

    buckets = narrow.groupBy(ref(target).alias("__class"), bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
    edge = crossing(buckets, "__bucket", F.lit(quota)).select(
        "__class", "__bucket", (F.lit(quota) - F.col("__upto") + F.col("__n")).alias("__left")
    )
    inside = _join_classes(narrow.withColumn("__own", bucket), target, edge, n_classes).filter("__own = __bucket")
    digests = inside.groupBy("__class", "__digest", "__left").agg(F.count(F.lit(1)).alias("__n"))
    return crossing(digests, "__digest", F.col("__left")).select(
        "__class",
        F.col("__digest").alias("__cut"),
        (F.col("__left") - F.col("__upto") + F.col("__n")).alias("__take"),
        F.col("__n").alias("__same"),
    )


def oversample(df: DataFrame, target: str, seed: int = SEED, piece: int = PIECE) -> DataFrame:
    """Every class (NULL is one) topped up to the size of the largest by draws with replacement; all rows stay.

    Draw ``i`` of a class takes the row whose rank in digest order is a hash of ``(seed, class, i)`` modulo the class
    size. Draws are counted per rank first and ranks per digest next, both on narrow rows; the wide rows of the
    smaller classes are shuffled once to meet their number of copies, and once to spread the copies.
    """
    require(df, target)
    require_groupable(df, [target])
    columns = [ref(c) for c in df.columns]
    digest = content_digest(df, df.columns, seed)
    sizes, n_classes, _, largest = _class_sizes(df, target)
    short = sizes.filter(F.col("__size") < largest).withColumn("__need", F.lit(largest) - F.col("__size"))
    draws = repeat_rows(short, F.col("__need"), [F.col("__class")], index="__draw", piece=piece)
    draw_digest = F.md5(
        F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("__class").cast("string"), F.lit("")), F.col("__draw").cast("string"))
    )
    # coalesce marks the rank as never NULL; otherwise the join adds a filter that computes each digest twice
    rank = F.coalesce(digest_number(draw_digest, 15) % F.col("__size"), F.lit(0))
    hits = (
        draws.select("__class", rank.alias("__rank"))
        .groupBy("__class", "__rank")
        .agg(F.count(F.lit(1)).alias("__hits"))
    )
    minor = _join_classes(df.withColumn("__digest", digest), target, short.select("__class"), n_classes)
    ranked = _ranks(minor.select("__class", "__digest"), piece)
    copies = (
        ranked.alias("r")
        .join(
            hits.alias("h"),
            F.col("r.__class").eqNullSafe(F.col("h.__class")) & (F.col("r.__rank") == F.col("h.__rank")),
        )
        .groupBy("r.__digest")
        .agg(F.sum("__hits").alias("__copies"))
    )
    originals = minor.select(*columns, "__digest").dropDuplicates(["__digest"])
    extra = repeat_rows(originals.join(copies, "__digest"), F.col("__copies"), [F.col("__digest")], piece=piece)
    return df.unionByName(extra.select(*columns))


def _ranks(rows: DataFrame, piece: int) -> DataFrame:
    """``(__class, __digest, __rank)``: the ranks from 0 that the copies of each digest take up within the class.

    A rank is the number of rows in earlier buckets plus the place inside the bucket. Copies are counted before, so
    a bucket holds each row once however many copies there are.
    """
    bucket = F.substring("__digest", 1, BUCKET_DIGITS)
    digests = rows.groupBy("__class", "__digest").agg(F.count(F.lit(1)).alias("__n"))
    digests = digests.withColumn("__bucket", bucket)
    earlier = Window.partitionBy("__class").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        digests.groupBy("__class", "__bucket")
        .agg(F.sum("__n").alias("__rows"))
        .select("__class", "__bucket", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__shift"))
    )
    within = Window.partitionBy("__class", "__bucket").orderBy("__digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = digests.withColumn("__place", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    started = placed.alias("p").join(
        shifts.alias("s"),
        F.col("p.__class").eqNullSafe(F.col("s.__class")) & (F.col("p.__bucket") == F.col("s.__bucket")),
    ).select("p.__class", "p.__digest", "p.__n", (F.col("__shift") + F.col("__place")).alias("__start"))
    unrolled = repeat_rows(started, F.col("__n"), [F.col("__digest")], index="__copy", piece=piece)
    return unrolled.select("__class", "__digest", (F.col("__start") + F.col("__copy")).alias("__rank"))


def resample(df: DataFrame, target: str, method: str, seed: int = SEED) -> DataFrame:
    """``method`` is ``over`` or ``under``."""
    if method == "over":
        return oversample(df, target, seed)
    if method == "under":
        return undersample(df, target, seed)
    raise ValueError(f"unknown method {method!r}, expected 'over' or 'under'")


def split_point(df: DataFrame, seed: int = SEED, key: Sequence[str] | None = None):
    """A number from 0 to 99 that depends on the content of the row only."""
    return digest_number(content_digest(df, list(key) if key else df.columns, seed), 8) % 100


def train_test_split(
    df: DataFrame, percent: int = TRAIN_PERCENT, seed: int = SEED, key: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows. Equal rows land on the same side, so no copy of a test row is trained on."""
    point = split_point(df, seed, key)
    return df.filter(point < percent), df.filter(point >= percent)
