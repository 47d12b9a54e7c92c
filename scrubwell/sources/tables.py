"""Tables in and out: CSV and Parquet scans, CSV sink, schema, preview and row counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubwell.functions.columns import is_string, local_rows, ref, require, unused_name


# What stands for NULL in files written exactly.
NULL_MARK = "\\N"
# Cells as other programs write them: quotes doubled, blanks kept.
_FORM = dict(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False, exact: bool = False, **options
) -> DataFrame:
    """A CSV file or folder with a header row. Give a schema where it is known: inference reads the data once more.

    ``multiline`` reads cells that hold line ends; such a file cannot be split between tasks, so parallelism is then the
    number of files. An empty cell is NULL, and so is an empty string in quotes. ``exact`` reads what ``write_csv`` wrote with
    ``exact``, cell by cell the same. It needs the schema, since texts may look like numbers.
    """
    reader = spark.read.options(**_FORM, multiLine=multiline or exact)
    if not exact:
        reader = reader.options(**options)
        return reader.schema(schema).csv(path) if schema is not None else reader.csv(path, inferSchema=True)
    if schema is None:
        raise ValueError("reading exactly needs the schema")
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    raw = reader.options(nullValue=NULL_MARK, emptyValue="", **options).schema(texts).csv(path)
    return raw.select(*[_unmarked(f).alias(f.name) for f in fields])


@dataclass(frozen=True)
class CsvScan:
    """``rows`` that fit the schema; ``malformed`` ones as ``(file, record)``; ``counts`` as ``(file, n_rows, n_malformed)``."""

    rows: DataFrame
    malformed: DataFrame
    counts: DataFrame


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = False, **options) -> CsvScan:
    """A CSV file or folder read against a schema, telling apart the rows that do not fit it.

    A row is malformed if it has too few or too many cells, or a cell that its column's type cannot take; an empty cell is
    NULL and fits. All columns are parsed whatever is selected later, as a row would otherwise be judged by some of its
    cells. Each part of the result reads the files once when it is used.
    """
    declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    record = unused_name("__record", [f.name.lower() for f in declared.fields])
    wanted = T.StructType([*declared.fields, T.StructField(record, T.StringType())])
    reader = spark.read.options(**_FORM, multiLine=multiline).options(**options)
    reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=record)
    read = reader.schema(wanted).csv(path).withColumn("__file", F.col("_metadata.file_path"))
    # Only cells that a query reads are parsed, so each of them is read, though what it holds makes no difference.
    beside = F.length(F.concat_ws("", *[ref(f.name).cast("string") for f in declared.fields])) >= 0
    bad = ref(record).isNotNull() & beside
    counts = read.groupBy(F.col("__file").alias("file")).agg(F.count_if(~bad).alias("n_rows"), F.count_if(bad).alias("n_malformed"))
    return CsvScan(
        read.filter(~bad).select(*[ref(f.name) for f in declared.fields]), read.filter(bad).select(F.col("__file").alias("file"), ref(record).alias("record")), counts
    )


def _marked(field: T.StructField) -> Column:
    """A cell as written: a text of backslashes and an N gets one backslash more, so it does not read as NULL."""
    cell = ref(field.name).cast("string")
    return F.regexp_replace(cell, r"^(\\+N)\z", r"\\$1") if is_string(field) else cell


def _unmarked(field: T.StructField) -> Column:
    cell = ref(field.name)
    return F.regexp_replace(cell, r"^\\(\\+N)\z", "$1") if is_string(field) else cell.cast(field.dataType)


def read_table(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).load(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", exact: bool = False) -> None:
    """The whole table as a folder of CSV files with a header, written by the executors.

    Cells with quotes, separators or line ends are quoted, with quotes doubled; blanks stay; NULL is an empty cell and the
    empty string two quotes, which most readers take for the same. With ``exact`` NULL is ``\\N``, and a text that consists of
    backslashes and an N gets one backslash more; ``read_csv(..., exact=True)`` then restores every cell.
    """
    writer = df.write.mode(mode).options(**_FORM)
    if exact:
        texts = df.select(*[_marked(f).alias(f.name) for f in df.schema.fields])
        writer = texts.write.mode(mode).options(**_FORM, nullValue=NULL_MARK, emptyValue='""')
    writer.csv(path)


def schema_listing(df: DataFrame) -> DataFrame:
    """``(position, column, data_type)``."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return local_rows(df.sparkSession, rows, "position int, column string, data_type string")


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """The first ``n`` rows; with ``order_by`` always the same ones, by a top-n that needs no full sort."""
    if order_by:
        df = df.orderBy(*[ref(c) if isinstance(c, str) else c for c in order_by])
    return df.limit(n)


def row_counts(versions: dict[str, DataFrame]) -> DataFrame:
    """``(version, n_rows)`` for each named version of a table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("version"), "n_rows")
        for name, df in versions.items()
    ]
    if not parts:
        raise ValueError("no versions given")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before, rows after, and how many were removed (negative when rows were added)."""
    require(before)
    counts = row_counts({"before": before, "after": after})
    return counts.agg(
        F.sum(F.when(F.col("version") == "before", F.col("n_rows"))).alias("rows_before"),
        F.sum(F.when(F.col("version") == "after", F.col("n_rows"))).alias("rows_after"),
    ).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))
