"""Run queries against their SQL by hand: ``python tests/check_oracle.py [sf_dir] [name …]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from scrubwell.queries import ORACLE, QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def compare(frame, connection, name: str) -> str | None:
    """``None`` when the query and its SQL agree in columns, types of numbers and rows; otherwise what differs."""
    columns = sorted(frame.columns)
    found = sorted(tuple(_cell(row[c]) for c in columns) for row in frame.collect())
    result = connection.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    kinds = {d[0]: str(d[1]) for d in result.description}
    for column, dtype in frame.dtypes:
        expected = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(dtype)
        if expected and kinds[column] != expected:
            return f"type of {column}: {dtype} against {kinds[column]}"
    wanted = sorted(tuple(_cell(row[i]) for i in order) for row in result.fetchall())
    if found != wanted:
        only_found = [r for r in found if r not in set(wanted)][:3]
        only_wanted = [r for r in wanted if r not in set(found)][:3]
        return f"{len(found)} rows against {len(wanted)}; {str(only_found)[:700]} ≠ {str(only_wanted)[:700]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    con = oracle_connection(folder)
    for key in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            if key in ORACLE:
                note = compare(QUERIES[key](session, folder), con, key) or "equal"
            else:
                note = f"{QUERIES[key](session, folder).count()} rows, no SQL"
        except Exception as error:
            note = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{key:32s} {time.time() - start:6.2f}s  {note}", flush=True)
