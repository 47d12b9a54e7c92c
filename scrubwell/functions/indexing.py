"""Dictionaries of the values of string columns: numbered by frequency, binned by a response, looked up by digest.

A dictionary is joined to rows by a 128-bit digest of the value, so however long values are, an entry that travels has a
fixed size; two values of one column that share a digest are noticed when it is built, and it then goes over to 256
bits. Values themselves are shuffled once, to be counted and put in order, and never broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubwell.functions.columns import ref
from scrubwell.functions.storage import cut_lineage

# Up to this many entries (16 bytes of digest and two numbers each) are joined by broadcast.
SMALL_INDEX = 100_000
# Values of this many bytes together are put in order by one task.
ORDERED_BYTES = 32 << 20
# A value on more than this share of the rows is joined by broadcast even when the others are shuffled; fewer than
# 1 / HOT_SHARE values can be that frequent.
HOT_SHARE = 0.001
# Categories of a feature that trees tell apart.
BINS = 64


def value_key(value: Column, wide: bool = False) -> Column:
    """The digest by which a value is looked up, 16 bytes or, where those were not enough, 32."""
    return F.unhex(F.sha2(value, 256) if wide else F.md5(value))


@dataclass(frozen=True)
class FrequencyIndex:
    """``table`` holds ``(__key, __value, __n, __index)``; index 0 is the most frequent value, ties in value order. After
    ``binned`` it also has ``__bin``, and ``unseen`` is the place among the bins of a value that is not in the table."""

    table: DataFrame
    size: int
    rows: int
    small_limit: int = SMALL_INDEX
    wide: bool = False
    unseen: float | None = None

    def look_up(self, df: DataFrame, value: Column, columns: dict[str, str]) -> DataFrame:
        """``df`` with columns of the table under new names, NULL where ``value`` is NULL or unknown.

        Beyond ``small_limit`` entries only frequent values are joined by broadcast and the others by shuffle, so that no
        task of the shuffled join gets all rows of one value; NULL never enters a join.
        """
        keyed = df.withColumn("__key", value_key(value, self.wide))
        entries = lambda table: table.select("__key", *[F.col(c).alias(n) for n, c in columns.items()])
        if self.size <= self.small_limit:
            return keyed.join(F.broadcast(entries(self.table)), "__key", "left").drop("__key")
        hot_floor = F.lit(int(self.rows * HOT_SHARE))
        hot, cold = (entries(self.table.filter(f)) for f in (F.col("__n") > hot_floor, F.col("__n") <= hot_floor))
        kinds = {f.name: f.dataType for f in hot.schema.fields}
        absent = keyed.filter(F.col("__key").isNull()).withColumns({n: F.lit(None).cast(kinds[n]) for n in columns})
        present = keyed.filter(F.col("__key").isNotNull())
        often = present.join(F.broadcast(hot), "__key")
        seldom = present.join(F.broadcast(hot.select("__key")), "__key", "left_anti").join(cold, "__key", "left")
        return often.unionByName(seldom).unionByName(absent).drop("__key")

    def attach(self, df: DataFrame, value: Column, name: str, keep_null: bool = False) -> DataFrame:
        """``df`` with the index of ``value`` in column ``name``; rows with an unknown value are dropped, and so are rows
        with NULL, unless ``keep_null``."""
        found = self.look_up(df.withColumn("__null", value.isNull()), value, {name: "__index"})
        known = ref(name).isNotNull()
        return found.filter(known | F.col("__null") if keep_null else known).drop("__null")

    def binned(self, bins: int = BINS) -> FrequencyIndex:
        """The values in the order of their mean response (ties in value order), cut into at most ``bins`` bins.

        Up to ``bins`` values have a bin each. More are dealt by the middle of their rows among all rows, so bins hold
        about as many rows. A value that the table lacks has a place of its own, where the mean of all rows would stand:
        half a step before the first bin whose mean is as high.
        """
        order = [F.asc(F.col("__sum") / F.col("__n")), F.asc("__value")]
        if self.size <= bins:
            placed = running_totals(self.table, order, F.lit(1).cast("bigint"), True).withColumn("__bin", F.col("__before").cast("double"))
        else:
            placed = running_totals(self.table, order, F.col("__n"), self.size <= self.small_limit, self.size)
            middle = F.expr(f"((2 * __before + __n) * {bins}) div {2 * self.rows}")
            placed = placed.withColumn("__bin", middle.cast("double"))
        table = cut_lineage(placed.select("__key", "__n", "__sum", "__index", "__bin"))
        of_bins = table.groupBy("__bin").agg(F.sum("__sum"), F.sum("__n")).collect()  # a row per bin
        mean = sum(s for _, s, _ in of_bins) / max(self.rows, 1)
        high = [b for b, s, n in of_bins if s / n >= mean]
        return replace(self, table=table, unseen=min(high, default=0.0) - 0.5)


def dictionaries(df: DataFrame, names: Sequence[str], response: Column | None = None, small_limit: int = SMALL_INDEX) -> dict[str, FrequencyIndex]:
    """A dictionary per string column, all counted in one scan; NULL is no value. With a ``response`` its sum per value is kept,
    for ``FrequencyIndex.binned``."""
    if not names:
        return {}
    y = F.lit(None).cast("double") if response is None else response
    flat = df.select(y.alias("__y"), *[ref(c) for c in names])
    long = flat.unpivot([F.col("__y")], [ref(c) for c in names], "__column", "__value").filter(F.col("__value").isNotNull())
    counted = long.groupBy("__column", "__value").agg(F.count(F.lit(1)).alias("__n"), F.sum("__y").alias("__sum"))
    counted = cut_lineage(counted)
    figures = counted.groupBy("__column").agg(
        F.count(F.lit(1)).alias("size"), F.sum("__n").alias("rows"), F.sum(F.octet_length("__value")).alias("bytes"),
        F.count_distinct(value_key(F.col("__value"))).alias("keys"),
    )
    known = {r["__column"]: r for r in figures.collect()}
    out = {}
    for name in names:
        size, rows, held, keys = known[name][1:] if name in known else (0, 0, 0, 0)
        wide = keys < size
        own = counted.filter(F.col("__column") == name).select(value_key(F.col("__value"), wide).alias("__key"), "__value", "__n", "__sum")
        order = [F.desc("__n"), F.asc("__value")]
        placed = running_totals(own, order, F.lit(1).cast("bigint"), size <= small_limit and held <= ORDERED_BYTES, size)
        columns = ["__key", "__value", "__n", F.col("__before").cast("double").alias("__index")] + ["__sum"] * (response is not None)
        out[name] = FrequencyIndex(placed.select(*columns), size, rows, small_limit, wide)
    return out


def frequency_index(df: DataFrame, name: str, small_limit: int = SMALL_INDEX) -> FrequencyIndex:
    """Number the values of ``name`` by falling frequency; NULL gets no number."""
    return dictionaries(df, [name], small_limit=small_limit)[name]


def running_totals(table: DataFrame, order: list[Column], weight: Column, small: bool, rows: int | None = None) -> DataFrame:
    """``table`` with ``__before``, the weight of all rows before a row in the given order.

    A small table is one window. Otherwise rows are range-partitioned by the order and written with their partition
    number; then each partition is added up on its own, shifted by the totals of the partitions before it. Writing fixes
    the partition numbers, so that totals and rows cannot disagree after a task is run again. With the number of ``rows``
    given, there are enough partitions for about ``SMALL_INDEX`` rows each, so that no task's window grows with the table.
    """
    earlier = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0).cast("bigint"))
    if small:
        return table.withColumn("__before", total(weight, earlier(Window.partitionBy(F.lit(0)).orderBy(*order))))
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, -(-rows // SMALL_INDEX)) if rows else parts
    ranged = cut_lineage(table.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("__range").agg(F.sum(weight).alias("__weight"))
    before = earlier(Window.partitionBy(F.lit(0)).orderBy("__range"))
    shifts = sums.select("__range", total("__weight", before).alias("__shift"))
    within = earlier(Window.partitionBy("__range").orderBy(*order))
    # as many tasks as ranges, about one range each, however few shuffle partitions are set
    placed = ranged.repartitionByRange(parts, "__range").withColumn("__own", total(weight, within))
    # one row per range: at most the setting or a row per SMALL_INDEX rows of the table
    joined = placed.join(F.broadcast(shifts), "__range")
    return joined.withColumn("__before", F.col("__shift") + F.col("__own")).drop("__range", "__own", "__shift")
