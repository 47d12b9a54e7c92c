"""Digests that only equal rows share, names that stay unique, and CSV files that lose nothing."""

import pytest
import scrubwell as sw
from pyspark.sql import functions as F
from scrubwell.functions.rows import content_digest


def digests(df):
    return [r[0] for r in df.select(content_digest(df, df.columns, 1)).collect()]


@pytest.mark.parametrize(
    "values",
    [
        "array('a','b'), array('a, b'), array('a',NULL,'b'), array('ab',''), array(), NULL",
        "named_struct('x', 'a', 'y', 'b'), named_struct('x', 'a, b', 'y', NULL), named_struct('x', NULL, 'y', NULL), NULL",
        "timestamp'2024-10-27 00:30:00', timestamp'2024-10-27 01:30:00', NULL",
        "X'00', X'0000', X'', NULL",
        "array(array(1), array(2)), array(array(1, 2)), array(array(1), array(), array(2)), array(NULL, array(1))",
        "'N', '1:a', '', NULL",
    ],
)
def test_unequal_cells_have_unequal_digests(spark, values):
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = spark.sql(f"SELECT explode(array({values})) AS c")
    found = digests(rows)
    assert len(set(found)) == len(found)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert "timestamp" in values or digests(rows) == found
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_instants_of_the_repeated_hour_differ(spark):
    rows = spark.sql("SELECT explode(array(timestamp_micros(1729987200000000), timestamp_micros(1729990800000000))) AS c")
    zone = spark.conf.get("spark.sql.session.timeZone")
    before = digests(rows)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert digests(rows) == before and len(set(before)) == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_zeros_are_one_value(spark):
    rows = spark.sql("SELECT explode(array(0.0D, -0.0D)) AS c")
    assert len(set(digests(rows))) == 1
    assert [(r["value"], r["n"]) for r in sw.top_values(rows).collect()] == [("0.0", 2)]


def test_resampling_tells_nested_rows_apart(spark):
    rows = spark.sql("SELECT 'x' AS k, array('a','b') AS v UNION ALL SELECT 'x', array('a, b') UNION ALL SELECT explode(array_repeat('y', 10)), array('c')")
    under = sw.undersample(rows, "k").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in under} == {"x": 2, "y": 2}
    over = sw.oversample(rows, "k").filter("k = 'x'").groupBy("v").count().collect()
    assert sum(r["count"] for r in over) == 10 and len(over) == 2


def test_a_column_with_nan_has_no_high_skew(spark):
    rows = spark.range(50).select(F.when(F.col("id") == 3, float("nan")).otherwise(F.exp("id")).alias("n"), F.exp("id").alias("e"))
    assert [r["column"] for r in sw.high_skew_columns(rows).collect()] == ["e"]


def test_calendar_parts_leave_own_columns_alone(spark):
    rows = spark.sql("SELECT timestamp'2024-05-06 07:08:09' AS ts, 'mine' AS ts_year, 'also' AS TS_YEAR_2")
    found = sw.timestamp_features(rows).first()
    assert found["ts_year"] == "mine" and found["TS_YEAR_2"] == "also" and found["ts_year_3"] == 2024 and found["ts_month"] == 5


def test_csv_restores_every_cell(spark, tmp_path):
    cells = [" lead", "trail ", "two\nlines", "a\r\nb\r", "\\N", "\\\\N", "\\", '"', '""', '"q","r"', "", None, "N", ",", "\t", "#c"]
    rows = spark.createDataFrame([(i, c, i / 3) for i, c in enumerate(cells)], "id int, cell string, d double")
    sw.write_csv(rows, str(tmp_path / "t"), exact=True)
    back = sw.read_csv(spark, str(tmp_path / "t"), schema=rows.schema, exact=True)
    assert back.schema == rows.schema
    by_id = lambda found: {r["id"]: tuple(r) for r in found}
    assert by_id(back.collect()) == by_id(rows.collect())
    alone = rows.select("cell")
    sw.write_csv(alone, str(tmp_path / "one"), exact=True)
    found = sw.read_csv(spark, str(tmp_path / "one"), schema=alone.schema, exact=True).collect()
    assert sorted(str(r["cell"]) for r in found) == sorted(map(str, cells))


def test_plain_csv_keeps_blanks_quotes_and_line_ends(spark, tmp_path):
    rows = spark.createDataFrame([(1, " lead ", 0.5), (2, 'two\n"lines"', None), (3, None, 2.5)], "id int, cell string, d double")
    sw.write_csv(rows, str(tmp_path / "t"))
    assert sorted(sw.read_csv(spark, str(tmp_path / "t"), multiline=True).collect()) == sorted(rows.collect())
