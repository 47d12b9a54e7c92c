"""Row identity by content, and row repetition that does not depend on how rows are partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubwell.functions.columns import ref
from scrubwell.functions.storage import cut_lineage

# A row that is to appear more often than this is first split into pieces that different tasks repeat.
PIECE = 1 << 20
# Key tables up to this many rows (16 bytes each) are broadcast.
BROADCAST_KEYS = 2_000_000


def canonical_type(kind: T.DataType) -> T.DataType:
    """The type of ``canonical`` cells: maps become arrays of entries, inside arrays and structs too."""
    if isinstance(kind, T.MapType):
        entry = [T.StructField("key", canonical_type(kind.keyType)), T.StructField("value", canonical_type(kind.valueType))]
        return T.ArrayType(T.StructType(entry))
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(canonical_type(kind.elementType), kind.containsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, canonical_type(f.dataType), f.nullable) for f in kind.fields])
    return kind


def holds_map(kind: T.DataType) -> bool:
    return canonical_type(kind) != kind


def canonical(value: Column, kind: T.DataType) -> Column:
    """A cell with its maps as arrays of entries sorted by key, so that equal maps are equal arrays and rows with maps can be
    grouped, hashed and compared."""
    if not holds_map(kind):
        return value
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(value), entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: canonical(item, kind.elementType))
    fields = [canonical(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
    return F.when(value.isNotNull(), F.struct(*fields))


def restored(value: Column, kind: T.DataType) -> Column:
    """What ``canonical`` was made from; ``kind`` is the type with maps."""
    if not holds_map(kind):
        return value
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(e["key"].alias("key"), restored(e["value"], kind.valueType).alias("value"))
        return F.map_from_entries(F.transform(value, entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: restored(item, kind.elementType))
    fields = [restored(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
    return F.when(value.isNotNull(), F.struct(*fields))


def with_canonical_maps(df: DataFrame) -> DataFrame:
    maps = {f.name: canonical(ref(f.name), f.dataType) for f in df.schema.fields if holds_map(f.dataType)}
    return df.withColumns(maps) if maps else df


def with_restored_maps(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns that are maps in ``schema`` as maps again."""
    kinds = {f.name: f.dataType for f in schema.fields if holds_map(f.dataType) and f.name in df.columns}
    return df.withColumns({c: restored(ref(c), kind) for c, kind in kinds.items()}) if kinds else df


def _written(value: Column, kind: T.DataType) -> Column:
    """A cell as text that only equal cells of its type share: length and text, nested cells inside with their own."""
    if isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(value, lambda item: _written(item, kind.elementType)), "")
        text = F.concat(F.size(value).cast("string"), F.lit("["), text)
    elif isinstance(kind, T.StructType):
        text = F.concat(F.lit("{"), *[_written(value.getField(f.name), f.dataType) for f in kind.fields])
        text = F.when(value.isNotNull(), text)
    elif isinstance(kind, T.MapType):  # entries by key, whatever order they were put in
        text = _written(canonical(value, kind), canonical_type(kind))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = F.when(value == 0, F.abs(value)).otherwise(value).cast("string")  # 0.0 and -0.0 are equal
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(value).cast("string")  # the instant, whatever the session's zone prints
    elif isinstance(kind, T.BinaryType):
        text = F.hex(value)
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("N"))


def content_digest(df: DataFrame, names: Sequence[str], seed: int | str) -> Column:
    """MD5 of the named cells of ``df``. Each cell is written with its length, so only equal rows have equal input."""
    return F.md5(F.concat(F.lit(f"{seed}|"), *[_written(ref(n), df.schema[n].dataType) for n in names]))


def digest_number(digest: Column, hex_digits: int) -> Column:
    """The leading hex digits of a digest as a non-negative bigint (15 digits at most)."""
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("bigint")


def repeat_rows(df: DataFrame, times: Column, by: Sequence[Column], index: str | None = None, piece: int = PIECE) -> DataFrame:
    """Each row ``times`` times, optionally numbered from 0 in ``index``.

    Counts above ``piece`` are split and shuffled before they are unrolled, so one row repeated a billion times is
    the work of many tasks. The partition number is explicit: adaptive coalescing looks at bytes before unrolling
    and would put all pieces together.
    """
    columns = [ref(c) for c in df.columns]
    pieces = df.select(*columns, times.cast("bigint").alias("__times")).filter(F.col("__times") > 0)
    pieces = pieces.select(
        "*", F.explode(F.sequence(F.lit(0), F.floor((F.col("__times") - 1) / F.lit(piece)))).alias("__piece")
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(parts, F.col("__piece"), *by)
    start = F.col("__piece") * F.lit(piece)
    last = F.least(F.col("__times"), start + F.lit(piece)) - 1
    unrolled = pieces.select(*columns, F.explode(F.sequence(start, last)).alias("__i"))
    if index is None:
        return unrolled.select(*columns)
    return unrolled.select(*columns, F.col("__i").alias(index))


def repeated_keys(df: DataFrame, names: Sequence[str], limit: int = BROADCAST_KEYS) -> DataFrame | None:
    """64-bit hashes of ``names`` that occur on more than one row, ready to broadcast; ``None`` beyond ``limit``.

    Only the hash is shuffled, so finding out which rows may have copies costs eight bytes a row however wide the
    rows are. Unequal rows can share a hash: callers compare the real columns of the few rows that are left.
    """
    hashed = df.select(row_hash(names).alias("__key"))
    repeated = hashed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__key")
    repeated = cut_lineage(repeated)
    return repeated if repeated.count() <= limit else None


def row_hash(names: Sequence[str]) -> Column:
    return F.xxhash64(*[ref(n) for n in names])
