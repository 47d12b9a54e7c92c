"""Arrow batches in bounded pieces, for operators that run Python inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a piece; texts of one piece are Python objects at the same time.
PIECE_ROWS = 256


def pieces(batches: Iterable[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, without copying. At the end Arrow gives back what it holds in reserve, as the worker
    process goes on to other tasks."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A string column, NULL as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A string column as UTF-8, NULL as the empty text."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every document operator needs, under fixed names; others never meet the operator's own names."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def row_digest(doc_id: Column, text: Column) -> Column:
    """64 bits that tell apart rows which share their id; NULL and the empty text differ."""
    return F.xxhash64(doc_id, text, text.isNull())


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it, if they are not told another place."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
