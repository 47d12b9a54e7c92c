import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import scrubwell as sw
from helpers import rows


def expected(text):
    """The same cleaning for one string, said with Python's own regular expressions."""
    if text is None:
        return None
    return re.sub(r"\s+", " ", re.sub(r"(?:http|www)\S+", "", text.lower())).strip()


CASES = [
    None, "", "   ", "Plain TEXT", "see HTTP://X.y/z now", "www.a.b", "http", "http now", "a\tb\n\nc", "x y z",
    "é Über ÀÉ", "www.a tail", "ahttps://q?x=1 b", "\x1cx\x1fy", "end https://a.b/c",
]


def cleaned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["t"] for r in sw.clean_text_columns(df, ["t"]).orderBy("i").collect()]


def test_clean_text(spark):
    assert cleaned(spark, CASES) == [expected(t) for t in CASES]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aBz.:/ \t\n  httpw", max_size=40), min_size=1, max_size=20))
def test_any_text(spark, texts):
    once = cleaned(spark, texts)
    assert once == [expected(t) for t in texts]


def test_only_text_columns(spark):
    with pytest.raises(ValueError, match="not text"):
        sw.clean_text_columns(spark.range(1), ["id"])
    with pytest.raises(ValueError, match="no column"):
        sw.clean_text_columns(spark.range(1), ["absent"])


def test_timestamp_parts(nulls):
    wide = sw.timestamp_features(nulls.select("ts", "tn", "dt"))
    assert wide.columns[3:] == [
        "ts_year", "ts_month", "ts_day", "ts_hour", "ts_dow", "tn_year", "tn_month", "tn_day", "tn_hour", "tn_dow",
        "dt_year", "dt_month", "dt_day", "dt_dow",
    ]
    first = wide.filter("ts = timestamp'2024-01-01 05:06:07'").first()
    assert tuple(first)[3:] == (2024, 1, 1, 5, 2, 2024, 2, 29, 23, 5, 2024, 1, 1, 2)
    sunday = wide.filter("dt = date'2024-01-07'").first()
    assert sunday["dt_dow"] == 1 and sunday["ts_dow"] == 1
    assert sw.timestamp_features(nulls.select("i")).columns == ["i"]


def test_preview_and_counts(spark):
    df = spark.range(100)
    assert [r["id"] for r in sw.preview(df, 3, ["id"]).collect()] == [0, 1, 2]
    assert sw.preview(df).count() == 5
    assert rows(sw.before_after(df, df.filter("id < 30"))) == [(100, 30, 70)]
    assert rows(sw.row_counts({"a": df, "b": df.limit(2)})) == [("a", 100), ("b", 2)]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you', None, 1.5, True), (2, "", "z", None, False)], "i int, s string, t string, d double, b boolean")
    path = str(tmp_path / "out")
    sw.write_csv(df, path)
    back = sw.read_csv(spark, path)
    assert rows(sw.schema_listing(back)) == [
        (0, "i", "int"), (1, "s", "string"), (2, "t", "string"), (3, "d", "double"), (4, "b", "boolean"),
    ]
    assert rows(back.select("i", "t", "d", "b")) == rows(df.select("i", "t", "d", "b"))
    typed = sw.read_csv(spark, path, "i bigint, s string, t string, d double, b boolean")
    assert typed.schema["i"].dataType.simpleString() == "bigint"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sw.write_csv(df, path)


def test_malformed_lines_are_told_apart(spark, tmp_path):
    first, second = tmp_path / "first.csv", tmp_path / "second.csv"
    first.write_text('a,b,c\n1,x,2.5\nword,x,2.5\n2,"quoted, text",\n3,x\n,,\n')
    second.write_text("a,b,c\n4,y,1e3\n5,y,1,extra\n6,y,much\n")
    scan = sw.scan_csv(spark, str(tmp_path), "a int, b string, c double")
    assert [tuple(r)[:2] for r in scan.rows.orderBy("a").collect()] == [(None, None), (1, "x"), (2, "quoted, text"), (4, "y")]
    assert {r["record"] for r in scan.malformed.collect()} == {"word,x,2.5", "3,x", "5,y,1,extra", "6,y,much"}
    counts = {r["file"].rsplit("/", 1)[1]: (r["n_rows"], r["n_malformed"]) for r in scan.counts.collect()}
    assert counts == {"first.csv": (3, 2), "second.csv": (1, 2)}
    assert scan.rows.select("b").count() == scan.rows.count() == 4
    empty = tmp_path / "none.csv"
    empty.write_text("a,b,c\n")
    nothing = sw.scan_csv(spark, str(empty), "a int, b string, c double")
    assert nothing.rows.count() == nothing.malformed.count() == 0
