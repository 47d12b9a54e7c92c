"""Column references, type classes and report helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESERVED = "__"


def ref(name: str) -> Column:
    """Column reference that survives blanks, dots and back-ticks in ``name``."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_string(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def is_timestamp(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType))


def is_date(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.DateType)


def is_floating(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.FloatType, T.DoubleType))


def _pick(df: DataFrame, test, exclude: Iterable[str | None]) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if test(f) and f.name not in skip]


def numeric_columns(df: DataFrame, exclude: Iterable[str | None] = ()) -> list[str]:
    return _pick(df, is_numeric, exclude)


def string_columns(df: DataFrame, exclude: Iterable[str | None] = ()) -> list[str]:
    return _pick(df, is_string, exclude)


def timestamp_columns(df: DataFrame, exclude: Iterable[str | None] = ()) -> list[str]:
    return _pick(df, is_timestamp, exclude)


def date_columns(df: DataFrame, exclude: Iterable[str | None] = ()) -> list[str]:
    return _pick(df, is_date, exclude)


def require(df: DataFrame, *names: str | None) -> None:
    """Fail early, with the list of columns, when a named column is absent or a reserved name is in use."""
    for name in names:
        if name is not None and name not in df.columns:
            raise ValueError(f"no column {name!r}; the table has {df.columns}")
    taken = [c for c in df.columns if c.startswith(RESERVED)]
    if taken:
        raise ValueError(f"column names starting with {RESERVED!r} are reserved: {taken}")


def require_groupable(df: DataFrame, names: Sequence[str]) -> None:
    """Rows with a map cannot be grouped or compared; say so before Spark's analyzer does."""

    def holds_map(dtype: T.DataType) -> bool:
        if isinstance(dtype, T.MapType):
            return True
        if isinstance(dtype, T.ArrayType):
            return holds_map(dtype.elementType)
        if isinstance(dtype, T.StructType):
            return any(holds_map(f.dataType) for f in dtype.fields)
        return False

    wanted = set(names)
    bad = [f.name for f in df.schema.fields if f.name in wanted and holds_map(f.dataType)]
    if bad:
        raise ValueError(f"map columns cannot be compared for equality, drop or convert them first: {bad}")


def unused_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or with the first number from 2 on that makes it unlike all of ``taken`` (in lower case)."""
    free = name
    number = 2
    while free.lower() in taken:
        free, number = f"{name}_{number}", number + 1
    return free


def as_double(df: DataFrame, name: str) -> Column:
    """The column as double, NaN read as NULL (quantiles, bounds and moments skip both)."""
    value = ref(name).cast("double")
    if is_floating(df.schema[name]):
        return F.when(~F.isnan(value), value)
    return value


def aggregate_row(df: DataFrame, exprs: Sequence[Column]) -> list:
    """All aggregates of ``exprs`` in one job; their values in order."""
    if not exprs:
        return []
    return list(df.agg(*[e.alias(f"__{i}") for i, e in enumerate(exprs)]).first())


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def local_rows(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A small table of values that the driver holds anyway, such as a line per column or per model."""
    fields = T._parse_datatype_string(schema).fields
    cells = {
        f.name: pa.array([row[i] for row in rows], _ARROW[f.dataType.simpleString()]) for i, f in enumerate(fields)
    }
    return spark.createDataFrame(pa.table(cells), schema=schema)


def empty(df: DataFrame, schema: str) -> DataFrame:
    return local_rows(df.sparkSession, [], schema)


def report(df: DataFrame, lines: Sequence[dict[str, Column]], schema: str) -> DataFrame:
    """One aggregate over ``df`` turned into a small table, a row per entry of ``lines``.

    The values may be aggregates or literals. However many lines there are, it is one job and one scan.
    """
    if not lines:
        return empty(df, schema)
    fields = T._parse_datatype_string(schema).fields
    rows = [F.struct(*[line[f.name].cast(f.dataType).alias(f.name) for f in fields]) for line in lines]
    return df.agg(F.array(*rows).alias("__rows")).select(F.inline("__rows"))


def fused_reports(df: DataFrame, parts: dict[str, tuple[Sequence[dict[str, Column]], str]]) -> dict[str, DataFrame]:
    """Several reports from a single scan: the lines of all parts are computed by one aggregate, then kept as rows."""
    flat, spans = [], {}
    for key, (lines, schema) in parts.items():
        fields = T._parse_datatype_string(schema).fields
        spans[key] = (len(lines), schema, len(fields))
        flat += [line[f.name].cast(f.dataType) for line in lines for f in fields]
    values = iter(aggregate_row(df, flat))
    return {
        key: local_rows(df.sparkSession, [[next(values) for _ in range(width)] for _ in range(count)], schema)
        for key, (count, schema, width) in spans.items()
    }


def name_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per column name, without touching the data."""
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("column"))
