"""One entry per operator: the Spark query and, where SQL can say it, the statement it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import scrubwell as sw
from scrubwell.functions.storage import fresh_path
from scrubwell.queries import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sw.read_table(spark, f"{sf_dir}/{name}.parquet")


# The tables hold no gaps, so gaps are derived, in both languages by the same expressions.
GAP_COLUMNS = (
    "o_orderkey",
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS o_custkey",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderstatus END AS o_orderstatus",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
    "o_orderdate",
    "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
)
GAPS = "WITH gaps AS (SELECT " + ", ".join(GAP_COLUMNS) + " FROM orders)\n"
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*GAP_COLUMNS)


# ---- sources and sinks -------------------------------------------------------------------------------------------


def _csv_copy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    sw.write_csv(table(spark, sf_dir, name), path)
    return sw.read_csv(spark, path)


@query("csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, sf_dir):
    return _csv_copy(spark, sf_dir, "customer").withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


def _csv_texts(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = fresh_path(spark, "csv")
    sw.write_csv(rows, path, exact=True)
    return sw.read_csv(spark, path, schema=rows.schema, exact=True)


@query("csv_roundtrip_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip_documents(spark, sf_dir):
    return _csv_texts(spark, table(spark, sf_dir, "documents"))


@query("csv_roundtrip_pages", "SELECT page_id, url, html FROM pages")
def csv_roundtrip_pages(spark, sf_dir):
    return _csv_texts(spark, table(spark, sf_dir, "pages"))


_ODD_CELLS = """doc_id, CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('  ', lang, ' ') WHEN 3 THEN concat(lang, chr(10), source)
  WHEN 4 THEN concat('"', lang, '"",') WHEN 5 THEN concat(chr(92), 'N') WHEN 6 THEN concat(lang, chr(13), chr(10), chr(92))
  WHEN 7 THEN concat(chr(92), chr(92), 'N') ELSE concat(chr(9), lang, ',;') END AS cell"""


@query("csv_roundtrip_odd_cells", f"SELECT {_ODD_CELLS} FROM documents")
def csv_roundtrip_odd_cells(spark, sf_dir):
    odd = _ODD_CELLS.replace("chr(92), chr(92), 'N'", "char(92), char(92), 'N'")
    return _csv_texts(spark, table(spark, sf_dir, "documents").selectExpr(*[p for p in (odd.split(", ", 1))]))


@query(
    "csv_schema_listing",
    sql.union(
        [
            """SELECT 0 AS position, 'c_custkey' AS "column",
  CASE WHEN max(c_custkey) < 2147483648 THEN 'int' ELSE 'bigint' END AS data_type FROM customer""",
            "SELECT 1, 'c_name', 'string'",
            "SELECT 2, 'c_nationkey', 'int'",
            "SELECT 3, 'c_acctbal', 'double'",
            "SELECT 4, 'c_mktsegment', 'string'",
        ]
    ),
)
def csv_schema_listing(spark, sf_dir):
    return sw.schema_listing(_csv_copy(spark, sf_dir, "customer"))


@query("preview_topk", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def preview_topk(spark, sf_dir):
    return sw.preview(table(spark, sf_dir, "orders"), 50, [F.desc("o_totalprice"), "o_orderkey"])


@query(
    "before_after_counts",
    GAPS
    + """SELECT count(*) AS rows_before, count(n) AS rows_after, count(*) - count(n) AS rows_removed
FROM (SELECT CASE WHEN o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL
  AND o_orderpriority IS NOT NULL THEN 1 END AS n FROM gaps)""",
)
def before_after_counts(spark, sf_dir):
    raw = gaps(spark, sf_dir)
    return sw.before_after(raw, sw.handle_missing(raw, "drop"))


@query(
    "version_row_counts",
    "SELECT 'all' AS version, count(*) AS n_rows FROM documents UNION ALL "
    "SELECT 'distinct', count(*) FROM (SELECT DISTINCT text, lang FROM documents)",
)
def version_row_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    return sw.row_counts({"all": docs, "distinct": sw.drop_duplicates(docs)})


# ---- missing values ----------------------------------------------------------------------------------------------

_MISSING = {
    c: f"{c} IS NULL OR {c} = ''" if c in ("o_orderstatus", "o_orderpriority") else f"{c} IS NULL" for c in ORDER_COLUMNS
}
_MISSING_COUNTS = sql.union(
    f"""SELECT '{c}' AS "column", count(*) AS missing_count FROM gaps WHERE {test}""" for c, test in _MISSING.items()
)


@query("missing_counts", GAPS + _MISSING_COUNTS)
def missing_counts(spark, sf_dir):
    return sw.missing_counts(gaps(spark, sf_dir))


@query("missing_rows", GAPS + "SELECT * FROM gaps WHERE " + " OR ".join(f"({t})" for t in _MISSING.values()))
def missing_rows(spark, sf_dir):
    return sw.missing_rows(gaps(spark, sf_dir))


@query(
    "missing_columns",
    GAPS
    + f"""SELECT "column", missing_count, "column" IN ('o_orderkey', 'o_custkey', 'o_totalprice') AS is_numeric
FROM ({_MISSING_COUNTS}) WHERE missing_count > 0""",
)
def missing_columns(spark, sf_dir):
    return sw.missing_columns(gaps(spark, sf_dir))


@query(
    "drop_missing",
    GAPS + "SELECT * FROM gaps WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ORDER_COLUMNS),
)
def drop_missing(spark, sf_dir):
    return sw.handle_missing(gaps(spark, sf_dir), "drop")


def _filled(custkey: str, price: str, status: str = "o_orderstatus", priority: str = "o_orderpriority") -> str:
    return (
        GAPS
        + f"SELECT o_orderkey, {custkey} AS o_custkey, {status} AS o_orderstatus, {price} AS o_totalprice, "
        + f"o_orderdate, {priority} AS o_orderpriority FROM gaps"
    )


@query(
    "fill_mean",
    _filled(
        "coalesce(o_custkey, trunc((SELECT avg(o_custkey) FROM gaps))::BIGINT)",
        "round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM gaps)), 2)",
    ),
)
def fill_mean(spark, sf_dir):
    filled = sw.handle_missing(gaps(spark, sf_dir), "mean")
    return filled.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(
    "fill_median",
    _filled(
        "coalesce(o_custkey, trunc((SELECT quantile_cont(o_custkey::DOUBLE, 0.5) FROM gaps))::BIGINT)",
        "round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM gaps)), 2)",
    ),
)
def fill_median(spark, sf_dir):
    filled = sw.handle_missing(gaps(spark, sf_dir), "median", mode="exact")
    return filled.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("fill_zero", _filled("coalesce(o_custkey, 0)", "coalesce(o_totalprice, 0)"))
def fill_zero(spark, sf_dir):
    return sw.handle_missing(gaps(spark, sf_dir), "zero")


@query(
    "fill_unknown",
    _filled("o_custkey", "o_totalprice", "coalesce(o_orderstatus, 'Unknown')", "coalesce(o_orderpriority, 'Unknown')"),
)
def fill_unknown(spark, sf_dir):
    return sw.handle_missing(gaps(spark, sf_dir), "unknown")


@query(
    "fill_unknown_and_empty",
    _filled(
        "o_custkey", "o_totalprice",
        "coalesce(nullif(o_orderstatus, ''), 'Unknown')", "coalesce(nullif(o_orderpriority, ''), 'Unknown')",
    ),
)
def fill_unknown_and_empty(spark, sf_dir):
    return sw.handle_missing(gaps(spark, sf_dir), "unknown", empty_is_missing=True)


# ---- duplicates --------------------------------------------------------------------------------------------------


@query("duplicate_groups", "SELECT text, count(*) AS n_rows FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return sw.duplicate_groups(table(spark, sf_dir, "documents"), columns=["text"])


@query(
    "duplicate_groups_numeric",
    "SELECT l_suppkey, l_linenumber, l_quantity, count(*) AS n_rows FROM lineitem "
    "GROUP BY l_suppkey, l_linenumber, l_quantity HAVING count(*) > 1",
)
def duplicate_groups_numeric(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity", "l_discount")
    return sw.duplicate_groups(lines, target="l_discount")


_MAPPED = """SELECT event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, CAST(user_id % 3 AS INTEGER) AS u FROM events"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their properties as maps, put together in one order or the other."""
    frame = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "from_json(props, 'map<string,int>')['k'] AS k", "int(user_id % 3) AS u")
    return frame.selectExpr("event_type", "CASE WHEN event_id % 2 = 0 THEN map('k', k, 'u', u) ELSE map('u', u, 'k', k) END AS props")


@query("duplicate_groups_maps", f"SELECT event_type, k, u, count(*) AS n_rows FROM ({_MAPPED}) GROUP BY event_type, k, u HAVING count(*) > 1")
def duplicate_groups_maps(spark, sf_dir):
    return sw.duplicate_groups(_mapped(spark, sf_dir)).selectExpr("event_type", "props['k'] AS k", "props['u'] AS u", "n_rows")


@query("drop_duplicates_maps", f"SELECT DISTINCT event_type, k, u FROM ({_MAPPED})")
def drop_duplicates_maps(spark, sf_dir):
    return sw.drop_duplicates(_mapped(spark, sf_dir)).selectExpr("event_type", "props['k'] AS k", "props['u'] AS u")


@query("drop_duplicates", "SELECT DISTINCT text, source, lang FROM documents")
def drop_duplicates(spark, sf_dir):
    return sw.drop_duplicates(table(spark, sf_dir, "documents").select("text", "lang", "source"), "lang")


# ---- skew and entropy --------------------------------------------------------------------------------------------

LINE_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
)


@query("numeric_skewness", sql.skewness_lines("events", ["event_id", "user_id", "value"], []))
def numeric_skewness(spark, sf_dir):
    return sw.numeric_skewness(table(spark, sf_dir, "events"))


@query("categorical_entropy", sql.skewness_lines("documents", [], ["text", "lang", "source"]))
def categorical_entropy(spark, sf_dir):
    return sw.categorical_entropy(table(spark, sf_dir, "documents"))


@query(
    "skewness_report",
    sql.skewness_lines("lineitem", [c for c in LINE_NUMBERS if c != "l_tax"], ["l_returnflag", "l_linestatus"]),
)
def skewness_report(spark, sf_dir):
    return sw.skewness_report(table(spark, sf_dir, "lineitem"), "l_tax")


@query(
    "high_skew_columns",
    """SELECT "column", skewness FROM ("""
    + sql.skewness_lines("documents", ["doc_id", "n_chars"], [])
    + ") WHERE abs(skewness) > 1",
)
def high_skew_columns(spark, sf_dir):
    return sw.high_skew_columns(table(spark, sf_dir, "documents"))


def _skew_fixed(name: str, method: str) -> Callable:
    def run(spark, sf_dir):
        fixed, _ = sw.fix_skew(table(spark, sf_dir, name).drop("text", "props"), method)
        return fixed.withColumn("value", F.round("value", 6)) if name == "events" else fixed.withColumn(
            "n_chars", F.round("n_chars", 6)
        )

    return run


_EVENTS = "SELECT event_id, ts, user_id, event_type, round({}, 6) AS value FROM events"
_DOCS = "SELECT doc_id, lang, source, round({}, 6) AS n_chars FROM documents"
query("skew_log", _EVENTS.format("ln(1 + value)"))(_skew_fixed("events", "log"))
query("skew_sqrt", _DOCS.format("sqrt(n_chars)"))(_skew_fixed("documents", "sqrt"))
query("skew_cbrt", _EVENTS.format("cbrt(value)"))(_skew_fixed("events", "cbrt"))


# ---- outliers ----------------------------------------------------------------------------------------------------


@query("numeric_outliers", sql.outlier_lines("events", ["user_id", "value"], []))
def numeric_outliers(spark, sf_dir):
    return sw.numeric_outliers(table(spark, sf_dir, "events"), "event_id", mode="exact")


@query("rare_categories", sql.outlier_lines("documents", [], ["text", "lang", "source"]))
def rare_categories(spark, sf_dir):
    return sw.rare_categories(table(spark, sf_dir, "documents"))


@query(
    "outlier_report",
    sql.outlier_lines("lineitem", [c for c in LINE_NUMBERS if c != "l_tax"], ["l_returnflag", "l_linestatus"]),
)
def outlier_report(spark, sf_dir):
    return sw.outlier_report(table(spark, sf_dir, "lineitem"), "l_tax", mode="exact")


@query(
    "box_stats",
    sql.union(
        f"""SELECT '{c}' AS "column", count({c}) AS n, min({c})::DOUBLE AS min, {sql.rounded('any_value(q1)')} AS q1,
  {sql.rounded('any_value(q2)')} AS median, {sql.rounded('any_value(q3)')} AS q3, max({c})::DOUBLE AS max,
  min({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1))::DOUBLE AS whisker_low,
  max({c}) FILTER (WHERE {c} <= q3 + 1.5 * (q3 - q1))::DOUBLE AS whisker_high,
  count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_fliers
FROM events, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS q2,
  quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM events)"""
        for c in ("event_id", "user_id", "value")
    ),
)
def box_stats(spark, sf_dir):
    box = sw.box_stats(table(spark, sf_dir, "events"), mode="exact")
    return box.withColumns({c: F.round(c, 3) for c in ("q1", "median", "q3")})


def _bounds(column: str, source: str) -> str:
    q1, q3 = (f"(SELECT quantile_cont({column}::DOUBLE, {p}) FROM {source})" for p in (0.25, 0.75))
    return f"{column} BETWEEN {q1} - 5 * ({q3} - {q1}) AND {q3} + 5 * ({q3} - {q1})"


@query(
    "remove_outliers_joint",
    f"SELECT * FROM events WHERE {_bounds('user_id', 'events')} AND {_bounds('value', 'events')}",
)
def remove_outliers_joint(spark, sf_dir):
    return sw.remove_outliers(table(spark, sf_dir, "events"), "event_id", mode="exact")


@query(
    "remove_outliers_sequential",
    f"""WITH a AS (SELECT event_id, value, value * value AS squared FROM events),
b AS (SELECT * FROM a WHERE {_bounds('value', 'a')})
SELECT event_id, value, squared FROM b WHERE {_bounds('squared', 'b')}""",
)
def remove_outliers_sequential(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("event_id", "value", "value * value AS squared")
    return sw.remove_outliers(events, "event_id", mode="exact", order="sequential")


# ---- target ------------------------------------------------------------------------------------------------------


@query(
    "target_correlation",
    sql.correlation_lines(
        "lineitem", "l_extendedprice", [c for c in LINE_NUMBERS if c != "l_extendedprice"],
        ["l_returnflag", "l_linestatus"],
    ),
)
def target_correlation(spark, sf_dir):
    return sw.target_correlation(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(
    "target_correlation_classes",
    sql.correlation_lines(
        "orders", "o_orderpriority", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus"], ranked_target=True
    ),
)
def target_correlation_classes(spark, sf_dir):
    return sw.target_correlation(table(spark, sf_dir, "orders"), "o_orderpriority")


_COMPLETE = GAPS + ", whole AS (SELECT * FROM gaps WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL)\n"


@query(
    "target_correlation_gaps",
    GAPS
    + sql.correlation_lines("gaps", "o_totalprice", ["o_orderkey", "o_custkey"], ["o_orderstatus", "o_orderpriority"]),
)
def target_correlation_gaps(spark, sf_dir):
    return sw.target_correlation(gaps(spark, sf_dir), "o_totalprice")


@query(
    "target_correlation_complete",
    _COMPLETE
    + sql.correlation_lines("whole", "o_totalprice", ["o_orderkey", "o_custkey"], ["o_orderstatus", "o_orderpriority"]),
)
def target_correlation_complete(spark, sf_dir):
    return sw.target_correlation(gaps(spark, sf_dir), "o_totalprice", complete_cases=True)


@query("index_target", f"SELECT doc_id, source, n_chars, x AS lang FROM documents JOIN {sql.ranks('documents', 'lang')} ON lang = v")
def index_target(spark, sf_dir):
    return sw.index_target(table(spark, sf_dir, "documents").drop("text"), "lang")


@query("index_target_texts", f"SELECT doc_id, x AS text FROM documents JOIN {sql.ranks('documents', 'text')} ON text = v")
def index_target_texts(spark, sf_dir):
    """Nearly every text is a value of its own; numbered in ranges, as a table with many values is."""
    return sw.index_target(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", small_limit=100)


@query("class_distribution", "SELECT lang AS class, count(*) AS n FROM documents GROUP BY lang")
def class_distribution(spark, sf_dir):
    return sw.class_distribution(table(spark, sf_dir, "documents"), "lang")


@query(
    "class_imbalance",
    "SELECT count(*) AS n_classes, min(n) AS smallest, max(n) AS largest, max(n) > 1.5 * min(n) AS imbalanced "
    "FROM (SELECT count(*) AS n FROM documents GROUP BY lang)",
)
def class_imbalance(spark, sf_dir):
    return sw.class_imbalance(table(spark, sf_dir, "documents"), "lang")


_BROKEN = "c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0"


@query(
    "csv_malformed",
    f"""SELECT count(*) FILTER (NOT ({_BROKEN})) AS n_rows, count(*) FILTER ({_BROKEN}) AS n_malformed, 4::BIGINT AS n_files,
  count(*) FILTER (c_custkey % 13 = 0 AND NOT ({_BROKEN.replace(' OR c_custkey % 13 = 0', '')})) AS n_short,
  CAST(sum(c_custkey) FILTER (NOT ({_BROKEN})) AS BIGINT) AS keys, round(sum(c_acctbal) FILTER (NOT ({_BROKEN})), 2) AS balance FROM customer""",
)
def csv_malformed(spark, sf_dir):
    """Customers as lines, some with a word for a number, a cell too many or too few, read against the schema."""
    line = """concat_ws(',', c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN 'many' ELSE string(c_nationkey) END,
      CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE string(c_acctbal) END, CASE WHEN c_custkey % 11 = 0 THEN 'more' END)"""
    lines = table(spark, sf_dir, "customer").selectExpr("c_custkey % 4 AS part", f"{line} AS value")
    path = fresh_path(spark, "broken")
    lines.repartition(4, "part").write.partitionBy("part").text(path)
    scan = sw.scan_csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double", header=False, recursiveFileLookup=True)
    counts = scan.counts.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_malformed").alias("n_malformed"), F.count(F.lit(1)).alias("n_files"))
    short = scan.malformed.agg(F.count_if((F.size(F.split("record", ",")) == 3) & ~F.col("record").contains("many")).alias("n_short"))
    good = scan.rows.agg(F.sum("c_custkey").alias("keys"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    lines = counts.unionByName(short, allowMissingColumns=True).unionByName(good, allowMissingColumns=True)
    return lines.agg(*[F.max(c).alias(c) for c in lines.columns])  # three lines of one figure or more each


# ---- profile and report ------------------------------------------------------------------------------------------

_PROFILED = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


def _profile_line(column: str, kind: str) -> str:
    number = f"{column}::DOUBLE" if kind != "string" else "NULL::DOUBLE"
    text = column if kind == "string" else "NULL::VARCHAR"
    gap = f"{column} IS NULL OR {column} = ''" if kind == "string" else f"{column} IS NULL"
    quantiles = ", ".join(
        f"{sql.rounded(f'quantile_cont({number}, {p})', 2)} AS {n}"
        for n, p in (("q05", 0.05), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q95", 0.95))
    )
    return f"""SELECT '{column}' AS "column", '{kind}' AS type, count(*) AS n, count(*) FILTER (WHERE {gap}) AS n_missing,
  round(count(*) FILTER (WHERE {gap}) / count(*)::DOUBLE, 3) AS p_missing, count(DISTINCT {column}) AS n_distinct,
  min({number}) AS min, max({number}) AS max, {sql.rounded(f'avg({number})', 2)} AS mean,
  {sql.rounded(f'stddev_samp({number})', 2)} AS std, count(*) FILTER (WHERE {number} = 0) AS n_zeros, {quantiles},
  min({text}) AS min_text, max({text}) AS max_text FROM customer"""


@query("column_profile", sql.union(_profile_line(c, k) for c, k in _PROFILED.items()))
def column_profile(spark, sf_dir):
    profile = sw.column_profile(table(spark, sf_dir, "customer"), mode="exact")
    figures = ("mean", "std", "q05", "q25", "q50", "q75", "q95")
    return profile.withColumns({c: F.round(c, 2) for c in figures} | {"p_missing": F.round("p_missing", 3)})


@query(
    "top_values",
    sql.union(
        f"""SELECT '{c}' AS "column", rank::INTEGER AS rank, value, n FROM (SELECT {c}::VARCHAR AS value, count(*) AS n,
  row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS rank FROM customer GROUP BY {c}) WHERE rank <= 5"""
        for c in _PROFILED
    ),
)
def top_values(spark, sf_dir):
    return sw.top_values(table(spark, sf_dir, "customer"), 5)


_PARTS = {
    "year": "year({})", "month": "month({})", "day": "day({})", "hour": "hour({})", "dow": "dayofweek({}) + 1",
}


def _calendar(column: str, parts=tuple(_PARTS)) -> str:
    return ", ".join(f"({_PARTS[p].format(column)})::INTEGER AS {column}_{p}" for p in parts)


_WIDE = f"WITH wide AS (SELECT *, {_calendar('ts')} FROM events)\n"
_WIDE_NUMBERS = ["event_id", "user_id", "value"] + [f"ts_{p}" for p in _PARTS]
_REPORT = [
    *(
        f"SELECT 'missing' AS issue, '{c}' AS item, count(*)::DOUBLE AS value FROM wide WHERE {c} IS NULL"
        + (f" OR {c} = ''" if c in ("event_type", "props") else "")
        for c in ["event_id", "ts", "user_id", "event_type", "value", "props"] + [f"ts_{p}" for p in _PARTS]
    ),
    """SELECT 'skewness', "column", coalesce(skewness, entropy) FROM ("""
    + sql.skewness_lines("wide", _WIDE_NUMBERS, ["props"]) + ")",
    """SELECT 'high_skew', "column", skewness FROM ("""
    + sql.skewness_lines("wide", _WIDE_NUMBERS, []) + ") WHERE abs(skewness) > 1",
    """SELECT 'outliers', "column", outlier_count::DOUBLE FROM ("""
    + sql.outlier_lines("wide", _WIDE_NUMBERS, ["props"]) + ")",
    "SELECT 'correlation', feature, correlation FROM ("
    + sql.correlation_lines("wide", "event_type", _WIDE_NUMBERS, [], ranked_target=True) + ")",
    "SELECT 'duplicates', 'groups', count(*)::DOUBLE FROM "
    "(SELECT 1 FROM wide GROUP BY event_id, ts, user_id, value, props HAVING count(*) > 1)",
    "SELECT 'classes', event_type, count(*)::DOUBLE FROM wide GROUP BY event_type",
    "SELECT 'imbalance', 'event_type', (max(n) > 1.5 * min(n))::INTEGER::DOUBLE FROM "
    "(SELECT count(*) AS n FROM wide GROUP BY event_type)",
]


@query("issue_report", _WIDE + sql.union(_REPORT))
def issue_report(spark, sf_dir):
    return sw.issue_table(table(spark, sf_dir, "events"), "event_type", "classification", mode="exact")


# ---- text, timestamps, plan --------------------------------------------------------------------------------------

_BLANK = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{0B}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NO_BLANK = _BLANK.replace("[", "[^", 1)


def _cleaned(column: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({column}), '(http|www){_NO_BLANK}+', '', 'g'), '{_BLANK}+', ' ', 'g'), ' ')"


@query("clean_text", f"SELECT page_id, {_cleaned('url')} AS url, {_cleaned('html')} AS html FROM pages")
def clean_text(spark, sf_dir):
    return sw.clean_text_columns(table(spark, sf_dir, "pages"), ["url", "html"])


@query("clean_text_documents", f"SELECT doc_id, {_cleaned('text')} AS text, lang, source, n_chars FROM documents")
def clean_text_documents(spark, sf_dir):
    return sw.clean_text_columns(table(spark, sf_dir, "documents"), ["text"])


@query("timestamp_features", f"SELECT *, {_calendar('ts')} FROM events")
def timestamp_features(spark, sf_dir):
    return sw.timestamp_features(table(spark, sf_dir, "events"))


@query(
    "cleaning_plan",
    GAPS
    + f""", filled AS (SELECT o_orderkey, coalesce(o_custkey, 0) AS o_custkey, o_orderstatus,
  coalesce(o_totalprice, 0) AS o_totalprice, o_orderdate, o_orderpriority FROM gaps),
inside AS (SELECT * FROM filled WHERE {_bounds('o_orderkey', 'filled')} AND {_bounds('o_totalprice', 'filled')}
  AND {_bounds('o_custkey', 'filled')}),
ranked AS {sql.ranks('gaps', 'o_orderpriority')}
SELECT o_orderkey, o_custkey, {_cleaned('o_orderstatus')} AS o_orderstatus, o_totalprice, o_orderdate, x AS o_orderpriority,
  {_calendar('o_orderdate')}
FROM inside JOIN ranked ON o_orderpriority = v""",
)
def cleaning_plan(spark, sf_dir):
    plan = (
        sw.CleaningPlan("o_orderpriority")
        .handle_missing("zero")
        .remove_outliers(mode="exact")
        .index_target()
        .drop_duplicates()
        .clean_text(["o_orderstatus"])
        .timestamp_features()
    )
    return plan.apply(gaps(spark, sf_dir))


@query(
    "cleaning_plan_events",
    f"""WITH doubled AS (SELECT user_id, event_type, CASE WHEN event_id % 50 = 0 THEN value * 100 WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value
  FROM events UNION ALL SELECT user_id, event_type, CASE WHEN event_id % 50 = 0 THEN value * 100 WHEN event_id % 9 = 0 THEN NULL ELSE value END FROM events WHERE event_id % 4 = 0),
once AS (SELECT DISTINCT user_id, event_type, coalesce(value, 0) AS value FROM doubled),
inside AS (SELECT * FROM once WHERE {_bounds('value', 'once')} AND {_bounds('user_id', 'once')})
SELECT event_type, user_id, CASE WHEN abs((SELECT {sql.skewness('value', 'inside')})) > 1 THEN round(ln(1 + value), 6) ELSE round(value, 6) END AS value,
  CASE WHEN abs((SELECT {sql.skewness('user_id', 'inside')})) > 1 THEN round(ln(1 + user_id), 6) ELSE user_id END::DOUBLE AS users FROM inside""",
)
def cleaning_plan_events(spark, sf_dir):
    """A plan whose every step changes something: gaps, repeated rows, outliers and skew."""
    cells = ("user_id", "event_type", "CASE WHEN event_id % 50 = 0 THEN value * 100 WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value")
    events = table(spark, sf_dir, "events")
    doubled = events.selectExpr(*cells).unionByName(events.filter("event_id % 4 = 0").selectExpr(*cells))
    plan = sw.CleaningPlan("event_type").handle_missing("zero").drop_duplicates().remove_outliers(mode="exact").fix_skew("log")
    cleaned = plan.apply(doubled)
    return cleaned.select("event_type", F.col("user_id").cast("bigint").alias("user_id"), F.round("value", 6).alias("value"), F.round(F.col("user_id").cast("double"), 6).alias("users"))


# ---- resampling and splitting ------------------------------------------------------------------------------------

_DOC_KEYS = ("doc_id", "lang", "source", "n_chars")
_RANKED = f"""WITH d AS (SELECT doc_id, lang, source, n_chars, {sql.digest(_DOC_KEYS)} AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS place, count(*) OVER (PARTITION BY lang) AS size FROM d),
c AS (SELECT lang, count(*) AS n FROM d GROUP BY lang)
"""


@query(
    "undersample",
    _RANKED + "SELECT doc_id, lang, source, n_chars FROM r WHERE place <= (SELECT min(n) FROM c)",
)
def undersample(spark, sf_dir):
    return sw.undersample(table(spark, sf_dir, "documents").select(*_DOC_KEYS), "lang")


_WHOLE = ("doc_id", "text", "lang", "source", "n_chars")


@query(
    "undersample_documents",
    f"""WITH d AS (SELECT *, {sql.digest(_WHOLE)} AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS place FROM d)
SELECT doc_id, text, lang, source, n_chars FROM r WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n FROM d GROUP BY lang))""",
)
def undersample_documents(spark, sf_dir):
    """Whole rows, texts included."""
    return sw.undersample(table(spark, sf_dir, "documents"), "lang")


_EVENT = ("event_id", "ts", "user_id", "event_type", "value", "props")


@query(
    "split_events",
    f"""SELECT event_id, ts, user_id, event_type, value, props,
  CASE WHEN {sql.hex_number(sql.digest(_EVENT), 8)} % 100 < 80 THEN 'train' ELSE 'test' END AS part FROM events""",
)
def split_events(spark, sf_dir):
    """Whole rows with timestamps, doubles and texts."""
    train, test = sw.train_test_split(table(spark, sf_dir, "events"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


_MANY = "CASE WHEN o_orderkey % 3 = 0 THEN 'most' ELSE o_orderkey::VARCHAR END AS class"


@query(
    "undersample_many_classes",
    f"""WITH d AS (SELECT o_orderkey, o_custkey, {_MANY} FROM orders), h AS (SELECT *, {sql.digest(("o_orderkey", "o_custkey", "class"))} AS h FROM d)
SELECT o_orderkey, o_custkey, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY h) AS place FROM h) WHERE place = 1""",
)
def undersample_many_classes(spark, sf_dir):
    """A class per order, and one that holds a third of them."""
    wide = _MANY.replace("o_orderkey::VARCHAR", "CAST(o_orderkey AS STRING)")
    return sw.undersample(table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", wide), "class")


_DRAW = sql.hex_number(f"md5('{sql.SEED}|' || lang || '|' || i::VARCHAR)", 15)


@query(
    "oversample",
    _RANKED
    + f""", draws AS (SELECT lang, {_DRAW} % n + 1 AS place
  FROM (SELECT lang, n, unnest(range((SELECT max(n) FROM c) - n)) AS i FROM c))
SELECT doc_id, lang, source, n_chars FROM d
UNION ALL
SELECT r.doc_id, r.lang, r.source, r.n_chars FROM draws JOIN r ON r.lang = draws.lang AND r.place = draws.place""",
)
def oversample(spark, sf_dir):
    return sw.oversample(table(spark, sf_dir, "documents").select(*_DOC_KEYS), "lang")


@query(
    "oversample_documents",
    f"""WITH d AS (SELECT *, {sql.digest(_WHOLE)} AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS place FROM d), c AS (SELECT lang, count(*) AS n FROM d GROUP BY lang),
draws AS (SELECT lang, {_DRAW} % n + 1 AS place FROM (SELECT lang, n, unnest(range((SELECT max(n) FROM c) - n)) AS i FROM c))
SELECT doc_id, text, lang, source, n_chars FROM d
UNION ALL SELECT r.doc_id, r.text, r.lang, r.source, r.n_chars FROM draws JOIN r ON r.lang = draws.lang AND r.place = draws.place""",
)
def oversample_documents(spark, sf_dir):
    """Whole rows, texts included."""
    return sw.oversample(table(spark, sf_dir, "documents"), "lang")


_COPIES = """WITH d AS (SELECT quality, toxic, {} AS h FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h) AS place FROM d),
c AS (SELECT quality, count(*) AS n FROM d GROUP BY quality)
""".format(sql.digest(("quality", "toxic")))


@query("undersample_copies", _COPIES + "SELECT quality, toxic FROM r WHERE place <= (SELECT min(n) FROM c)")
def undersample_copies(spark, sf_dir):
    return sw.undersample(table(spark, sf_dir, "labels").select("quality", "toxic"), "quality")


@query(
    "oversample_copies",
    _COPIES
    + f""", draws AS (SELECT quality, {sql.hex_number(f"md5('{sql.SEED}|' || quality::VARCHAR || '|' || i::VARCHAR)", 15)} % n + 1 AS place
  FROM (SELECT quality, n, unnest(range((SELECT max(n) FROM c) - n)) AS i FROM c))
SELECT quality, toxic FROM d
UNION ALL
SELECT r.quality, r.toxic FROM draws JOIN r ON r.quality = draws.quality AND r.place = draws.place""",
)
def oversample_copies(spark, sf_dir):
    return sw.oversample(table(spark, sf_dir, "labels").select("quality", "toxic"), "quality")


@query(
    "hash_split",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
  CASE WHEN {sql.hex_number(sql.digest(('o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority')), 8)} % 100 < 80
  THEN 'train' ELSE 'test' END AS part FROM orders""",
)
def hash_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    train, test = sw.train_test_split(orders)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


# ---- models ------------------------------------------------------------------------------------------------------


@query(
    "prepare_rows",
    GAPS
    + f"""SELECT o_orderkey, coalesce(o_custkey, -1) AS o_custkey, coalesce(o_orderstatus, 'missing') AS o_orderstatus,
  o_totalprice, coalesce(o_orderpriority, 'missing') AS o_orderpriority,
  {_calendar('o_orderdate', ('year', 'month', 'day'))} FROM gaps WHERE o_totalprice IS NOT NULL""",
)
def prepare_rows(spark, sf_dir):
    return sw.prepare_rows(gaps(spark, sf_dir), "o_totalprice", "regression")


@query(
    "prepare_text_rows",
    GAPS
    + f"""SELECT o_orderkey, coalesce(o_custkey, 0) AS o_custkey, coalesce(o_orderstatus, 'missing') AS o_orderstatus,
  coalesce(o_totalprice, 0) AS o_totalprice, o_orderpriority,
  {_calendar('o_orderdate', ('year', 'month', 'day'))} FROM gaps WHERE o_orderpriority IS NOT NULL""",
)
def prepare_text_rows(spark, sf_dir):
    return sw.prepare_rows(gaps(spark, sf_dir), "o_orderpriority", "text_classification")


@query(
    "max_bins",
    "SELECT 2 * greatest(32, (SELECT count(DISTINCT c_name) FROM customer), "
    "(SELECT count(DISTINCT c_mktsegment) FROM customer))::BIGINT AS max_bins",
)
def max_bins(spark, sf_dir):
    return sw.max_bins(table(spark, sf_dir, "customer"), "c_acctbal")


_GUESS = "o_custkey % 3 AS label, o_orderkey % 3 AS prediction"


# Weighted scores over ``p(label, prediction)``.
_SCORES = """s AS (SELECT c, (SELECT count(*) FROM p WHERE label = c) AS a, (SELECT count(*) FROM p WHERE prediction = c) AS g,
  (SELECT count(*) FROM p WHERE label = c AND prediction = c) AS t
  FROM (SELECT label AS c FROM p UNION SELECT prediction FROM p)),
m AS (SELECT a, t, coalesce(t / nullif(g, 0)::DOUBLE, 0) AS p, coalesce(t / nullif(a, 0)::DOUBLE, 0) AS r FROM s)
SELECT {}round(100 * sum(t)::DOUBLE / sum(a), 2) AS accuracy,
  round(100 * sum(a * coalesce(2 * p * r / nullif(p + r, 0), 0)) / sum(a), 2) AS f1,
  round(100 * sum(a * p) / sum(a), 2) AS "precision", round(100 * sum(a * r) / sum(a), 2) AS recall FROM m"""


@query("class_metrics", f"WITH p AS (SELECT {_GUESS} FROM orders),\n" + _SCORES.format(""))
def class_metrics(spark, sf_dir):
    return sw.classification_metrics(table(spark, sf_dir, "orders").selectExpr(*_GUESS.split(", ")))


@query(
    "confusion_counts",
    f"SELECT label::DOUBLE AS label, prediction::DOUBLE AS prediction, count(*) AS n FROM (SELECT {_GUESS} FROM orders) GROUP BY ALL",
)
def confusion_counts(spark, sf_dir):
    return sw.confusion_counts(table(spark, sf_dir, "orders").selectExpr(*_GUESS.split(", ")))


@query(
    "regression_metrics",
    "SELECT round(sqrt(avg(e * e)), 3) AS rmse, round(avg(e * e), 3) AS mse "
    "FROM (SELECT l_extendedprice / 1000 - l_quantity AS e FROM lineitem)",
)
def regression_metrics(spark, sf_dir):
    guesses = table(spark, sf_dir, "lineitem").selectExpr("l_extendedprice / 1000 AS label", "l_quantity AS prediction")
    return sw.regression_metrics(guesses)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id").drop("doc_id")


_PARTED = """, parted AS (SELECT *, {} % 100 < 80 AS train FROM rows)
"""


def _split_rows(select: str, columns: tuple[str, ...]) -> str:
    return f"WITH rows AS ({select})" + _PARTED.format(sql.hex_number(sql.digest(columns), 8))


@query(
    "eval_linear_regression",
    _split_rows("SELECT l_quantity, l_extendedprice FROM lineitem", ("l_quantity", "l_extendedprice"))
    + """, line AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS start
  FROM parted WHERE train)
SELECT 'Linear Regression' AS model, 'ok' AS status, (SELECT count(*) FROM parted WHERE train) AS n_train,
  count(*) AS n_test, count(*) AS n_scored, 1::BIGINT AS n_features, round(sqrt(avg(e * e)), 3) AS rmse, round(avg(e * e), 3) AS mse,
  NULL::VARCHAR AS error
FROM (SELECT l_extendedprice - start - slope * l_quantity AS e FROM parted, line WHERE NOT train)""",
)
def eval_linear_regression(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    return sw.evaluate(lines, "l_extendedprice", "regression", only=["Linear Regression"])


@query(
    "feature_vectors",
    f"""SELECT p.x AS label, o_custkey::DOUBLE AS f0, s.x AS f1, o_totalprice AS f2
FROM orders JOIN {sql.ranks('orders', 'o_orderpriority')} p ON o_orderpriority = p.v
JOIN {sql.ranks('orders', 'o_orderstatus')} s ON o_orderstatus = s.v""",
)
def feature_vectors(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    fitted = sw.fit_features(orders, "o_orderpriority", "classification")
    cells = vector_to_array("features")
    return fitted.transform(orders).select("label", *[cells[i].alias(f"f{i}") for i in range(3)])


def _vector_summary(vectors: DataFrame) -> DataFrame:
    """Label, number of occupied slots and their sum. The JSON form of a vector lists just the occupied slots."""
    values = F.from_json(F.get_json_object(F.to_json(F.struct("features")), "$.features.values"), "array<double>")
    total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b)
    counted = vectors.select("label", values.alias("v"))
    return counted.select("label", F.size("v").alias("n_slots"), F.round(total, 3).alias("total"))


# Words end at a single blank, so two blanks enclose an empty word; empty words at the end do not count.
_WORDS = r"regexp_split_to_array(regexp_replace(lower(text), '\s+$', ''), '\s')"


@query(
    "hashed_words",
    f"SELECT doc_id::DOUBLE AS label, round(len({_WORDS})::DOUBLE, 3) AS total FROM documents",
)
def hashed_words(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = sw.fit_features(documents, "doc_id", "classification")
    return _vector_summary(fitted.transform(documents)).select("label", "total")


_TOKENS = f"SELECT id, unnest({_WORDS}) AS word FROM texts"


@query(
    "tfidf_words",
    f"""WITH texts AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations),
counts AS (SELECT id, word, count(*) AS tf FROM ({_TOKENS}) GROUP BY id, word),
weights AS (SELECT word, ln(((SELECT count(*) FROM texts) + 1) / (count(*) + 1)::DOUBLE) AS idf FROM counts GROUP BY word)
SELECT id::DOUBLE AS label, count(*)::INTEGER AS n_slots, round(sum(tf * idf), 3) AS total
FROM counts JOIN weights USING (word) GROUP BY id""",
)
def tfidf_words(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS id", "text")
    fitted = sw.fit_features(texts, "id", "text_classification")
    total = F.aggregate("features", F.lit(0.0), lambda a, f: a + f["weight"])
    return fitted.transform(texts).select("label", F.size("features").alias("n_slots"), F.round(total, 3).alias("total"))


_BAYES = (
    _split_rows("SELECT text, quality FROM documents JOIN labels USING (doc_id)", ("text", "quality"))
    + f""", texts AS (SELECT row_number() OVER () AS id, text, quality, train FROM parted),
counts AS (SELECT id, word, count(*) AS tf FROM ({_TOKENS}) GROUP BY id, word),
learned AS (SELECT * FROM counts JOIN texts USING (id) WHERE train),
weights AS (SELECT word, ln(((SELECT count(*) FROM texts WHERE train) + 1) / (count(*) + 1)::DOUBLE) AS idf
  FROM learned GROUP BY word),
sums AS (SELECT quality, word, sum(tf * idf) AS s FROM learned JOIN weights USING (word) GROUP BY quality, word),
classes AS (SELECT quality, ln(count(*) + 1) - ln(sum(count(*)) OVER () + 2) AS prior FROM texts WHERE train GROUP BY quality),
norms AS (SELECT quality, ln(sum(s) + (SELECT count(*) FROM weights)) AS norm FROM sums GROUP BY quality),
scores AS (SELECT id, c.quality, any_value(prior) + coalesce(sum(tf * idf * (ln(coalesce(s, 0) + 1) - norm)), 0) AS score
  FROM texts t CROSS JOIN classes c JOIN norms n ON n.quality = c.quality LEFT JOIN counts USING (id)
  LEFT JOIN weights w ON w.word = counts.word LEFT JOIN sums ON sums.quality = c.quality AND sums.word = w.word
  WHERE NOT train GROUP BY id, c.quality),
p AS (SELECT t.quality AS label, arg_max(s.quality, s.score) AS prediction FROM texts t JOIN scores s USING (id) GROUP BY id, t.quality),
"""
)


_STATUS_TABLE = "SELECT o_orderstatus, o_totalprice FROM orders"
_GROUP_MEAN = _split_rows(_STATUS_TABLE, ("o_orderstatus", "o_totalprice"))


@query(
    "eval_tree_on_categories",
    _GROUP_MEAN
    + """, means AS (SELECT o_orderstatus, avg(o_totalprice) AS m FROM parted WHERE train GROUP BY o_orderstatus)
SELECT 'Decision Tree' AS model, 'ok' AS status, (SELECT count(*) FROM parted WHERE train) AS n_train, count(*) AS n_test,
  count(*) AS n_scored, 1::BIGINT AS n_features, round(sqrt(avg(e * e)), 3) AS rmse, round(avg(e * e), 3) AS mse, NULL::VARCHAR AS error
FROM (SELECT o_totalprice - m AS e FROM parted JOIN means USING (o_orderstatus) WHERE NOT train)""",
)
def eval_tree_on_categories(spark, sf_dir):
    """A tree on one category of three values predicts the mean of each."""
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice")
    return sw.evaluate(orders, "o_totalprice", "regression", only=["Decision Tree"])


_GRADES = "WHEN '1-URGENT' THEN {} WHEN '2-HIGH' THEN {} WHEN '3-MEDIUM' THEN {} ELSE {} END AS grade"


def _certain(models: tuple[str, ...], columns: tuple[str, ...], select: str, figures: str) -> str:
    """What models must score whose label is a function of one category: everything right."""
    counted = _split_rows(select, columns) + ", n AS (SELECT count(*) FILTER (train) AS a, count(*) FILTER (NOT train) AS b FROM parted)\n"
    lines = [
        f"SELECT '{m}' AS model, 'ok' AS status, a AS n_train, b AS n_test, b AS n_scored, 2::BIGINT AS n_features, {figures}, NULL::VARCHAR AS error FROM n"
        for m in models
    ]
    return counted + " UNION ALL ".join(lines)


_NUMBER_GRADES = "SELECT o_orderkey, o_orderpriority, CASE o_orderpriority " + _GRADES + " FROM orders"
_URGENT = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN {} ELSE {} END"


@query(
    "eval_certain_regression",
    _certain(
        ("Decision Tree",), ("o_orderkey", "o_orderpriority", "grade"),
        _NUMBER_GRADES.format("1.0::DOUBLE", "2.0::DOUBLE", "3.0::DOUBLE", "4.0::DOUBLE"), "0.0::DOUBLE AS rmse, 0.0::DOUBLE AS mse",
    ),
)
def eval_certain_regression(spark, sf_dir):
    """A tree on a number that a category decides, beside a key that says nothing: no error is left."""
    grade = "CASE o_orderpriority " + _GRADES.format("1D", "2D", "3D", "4D")
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderpriority", grade)
    return sw.evaluate(orders, "grade", "regression", only=["Decision Tree"])


@query(
    "eval_certain_classification",
    _certain(
        ("Decision Tree", "Random Forest", "Logistic Regression"), ("o_orderkey", "urgent", "grade"),
        f"SELECT o_orderkey, {_URGENT.format(1, 0)} AS urgent, {_URGENT.format(0, 1)} AS grade FROM orders",
        '100.0::DOUBLE AS accuracy, 100.0::DOUBLE AS f1, 100.0::DOUBLE AS "precision", 100.0::DOUBLE AS recall',
    ),
)
def eval_certain_classification(spark, sf_dir):
    """All three classifiers on a class that one of two features decides: all right."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_URGENT.format(1, 0)} AS urgent", f"{_URGENT.format(0, 1)} AS grade")
    return sw.evaluate(orders, "grade", "classification")


_TREE_SCORES = """
SELECT 'Decision Tree' AS model, 'ok' AS status, (SELECT count(*) FROM parted WHERE train) AS n_train, (SELECT count(*) FROM parted WHERE NOT train) AS n_test,
  count(*) AS n_scored, 2::BIGINT AS n_features, round(sqrt(avg((label - prediction) * (label - prediction))), 3) AS rmse,
  round(avg((label - prediction) * (label - prediction)), 3) AS mse, NULL::VARCHAR AS error FROM guesses"""


def _tree_on(select: str, columns: tuple[str, ...], category: str, number: str, target: str) -> str:
    return _split_rows(select, columns).rstrip() + ", " + sql.regression_tree(category, number, target) + _TREE_SCORES


@query(
    "eval_many_categories",
    _tree_on("SELECT c_name, c_acctbal, c_nationkey FROM customer", ("c_name", "c_acctbal", "c_nationkey"), "c_name", "c_nationkey", "c_acctbal"),
)
def eval_many_categories(spark, sf_dir):
    """Every customer's name is a value of its own, so no test row has one that was trained on: all are scored as unseen."""
    customers = table(spark, sf_dir, "customer").select("c_name", "c_acctbal", "c_nationkey")
    return sw.evaluate(customers, "c_acctbal", "regression", only=["Decision Tree"])


@query(
    "eval_repeated_categories",
    _tree_on("SELECT 'u' || user_id AS who, event_id % 17 AS part, value FROM events", ("who", "part", "value"), "who", "part", "value"),
)
def eval_repeated_categories(spark, sf_dir):
    """More users than a tree has bins, most of them in training and test rows."""
    events = table(spark, sf_dir, "events").selectExpr("concat('u', user_id) AS who", "event_id % 17 AS part", "value")
    return sw.evaluate(events, "value", "regression", only=["Decision Tree"])


@query("eval_regression")
def eval_regression(spark, sf_dir):
    return sw.evaluate(table(spark, sf_dir, "orders"), "o_totalprice", "regression")


@query("eval_classification")
def eval_classification(spark, sf_dir):
    return sw.evaluate(labelled(spark, sf_dir).drop("text"), "quality", "classification")


@query("eval_classification_words")
def eval_classification_words(spark, sf_dir):
    return sw.evaluate(labelled(spark, sf_dir).select("text", "lang", "quality"), "quality", "classification")


_TEXT_COUNTS = """(SELECT count(*) FROM texts WHERE train) AS n_train, (SELECT count(*) FROM texts WHERE NOT train) AS n_test,
  (SELECT count(*) FROM p) AS n_scored, (SELECT count(*) FROM weights) AS n_features, """


@query("eval_text", _BAYES + _SCORES.format("'Naive Bayes' AS model, 'ok' AS status, NULL::VARCHAR AS error, " + _TEXT_COUNTS))
def eval_text(spark, sf_dir):
    return sw.evaluate(labelled(spark, sf_dir).select("text", "quality"), "quality", "text_classification")


def _linear_scores(version: str, source: str) -> str:
    return f"""SELECT '{version}' AS version, (SELECT count(*) FROM {source} WHERE train) AS n_train, count(*) AS n_test,
  count(*) AS n_scored, 1::BIGINT AS n_features, round(sqrt(avg(e * e)), 3) AS rmse, round(avg(e * e), 3) AS mse FROM (
  SELECT value - start - slope * user_id AS e FROM {source},
    (SELECT regr_slope(value, user_id) AS slope, regr_intercept(value, user_id) AS start FROM {source} WHERE train)
  WHERE NOT train)"""


@query(
    "compare_linear_versions",
    _split_rows("SELECT user_id, value FROM events", ("user_id", "value"))
    + f""", inside AS (SELECT * FROM parted WHERE {_bounds('user_id', 'parted')}),
scores AS ({_linear_scores('raw', 'parted')} UNION ALL {_linear_scores('cleaned', '(SELECT DISTINCT * FROM inside)')})
SELECT version, 'Linear Regression' AS model, 'ok' AS status, n_train, n_test, n_scored, n_features, rmse, mse,
  CASE WHEN version = 'cleaned' THEN round(rmse - (SELECT rmse FROM scores WHERE version = 'raw'), 3) END AS rmse_change,
  CASE WHEN version = 'cleaned' THEN round(mse - (SELECT mse FROM scores WHERE version = 'raw'), 3) END AS mse_change,
  NULL::VARCHAR AS error
FROM scores""",
)
def compare_linear_versions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "value")
    plan = sw.CleaningPlan("value").remove_outliers(mode="exact").drop_duplicates()
    return sw.compare(events, plan, "value", "regression", only=["Linear Regression"])


@query("compare_versions")
def compare_versions(spark, sf_dir):
    plan = sw.CleaningPlan("value").drop_duplicates().remove_outliers().fix_skew("log")
    return sw.compare(table(spark, sf_dir, "events"), plan, "value", "regression", original_scale=True)


@query("compare_text_versions")
def compare_text_versions(spark, sf_dir):
    plan = sw.CleaningPlan("quality").drop_duplicates().clean_text(["text"]).resample("over", train_only=True)
    return sw.compare(labelled(spark, sf_dir).select("text", "quality"), plan, "quality", "text_classification")


# ---- approximate quantiles ---------------------------------------------------------------------------------------


def _within_error(df: DataFrame, found: dict[tuple[str, float], float], error: float) -> DataFrame:
    """Whether each value found for a column and probability has a rank that is off by ``error`` at most."""
    n = F.count(F.lit(1))
    parts = []
    for (name, p), value in found.items():
        below, upto = (F.count_if(F.col(name) < value), F.count_if(F.col(name) <= value))
        near = (upto >= F.ceil((F.lit(p) - error) * n)) & (below <= F.floor((F.lit(p) + error) * n))
        parts.append(F.struct(F.lit(name).alias("column"), F.lit(p).alias("p"), near.alias("within")))
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def _all_within(columns: tuple[str, ...], probs: tuple[float, ...]) -> str:
    return sql.union([f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS p, true AS within" for c in columns for p in probs])


_LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")


@query("default_quartiles_within_error", _all_within(_LINE_NUMBERS, (0.25, 0.75)))
def default_quartiles_within_error(spark, sf_dir):
    """What outlier detection and box statistics report without arguments, by the rank of each value."""
    lines = table(spark, sf_dir, "lineitem").select(*_LINE_NUMBERS)
    boxes = {r["column"]: r for r in sw.box_stats(lines).collect()}
    return _within_error(lines, {(c, p): boxes[c][q] for c in _LINE_NUMBERS for p, q in ((0.25, "q1"), (0.75, "q3"))}, 0.05)


@query("default_median_within_error", _all_within(("o_totalprice",), (0.5,)))
def default_median_within_error(spark, sf_dir):
    """The median that fills gaps without arguments, by its rank among the values that are there."""
    orders = gaps(spark, sf_dir).select("o_orderkey", "o_totalprice")
    filled = sw.handle_missing(orders, "median").withColumnRenamed("o_totalprice", "filled")
    value = filled.join(orders.filter("o_totalprice IS NULL"), "o_orderkey").agg(F.max("filled")).first()[0]
    return _within_error(orders.filter("o_totalprice IS NOT NULL"), {("o_totalprice", 0.5): value}, 0.01)


# ---- mergeable states --------------------------------------------------------------------------------------------


def _stored(spark: SparkSession, frame: DataFrame, label: str) -> DataFrame:
    path = fresh_path(spark, label)
    frame.write.partitionBy("part").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


_PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("quantiles_from_parts", _all_within(_LINE_NUMBERS, _PROBS))
def quantiles_from_parts(spark, sf_dir):
    """Quantiles of eight parts' stored sketches, merged, by the rank of each value among all rows."""
    lines = table(spark, sf_dir, "lineitem").select(*_LINE_NUMBERS)
    parts = _stored(spark, sw.table_states(lines, F.pmod(F.xxhash64(*_LINE_NUMBERS), F.lit(8))), "line-states")
    found = sw.quantiles_of_states(sw.merge_states(parts), _PROBS).collect()
    return _within_error(lines, {(r["column"], r["p"]): r["value"] for r in found}, 0.005)


@query(
    "report_from_parts",
    _WIDE
    + sql.union(
        [part for part in _REPORT if not any(f"SELECT '{i}'" in part for i in ("outliers", "correlation", "duplicates"))]
        + [f"SELECT 'rare', 'props', {sql.rare_values('props', 'wide')}::DOUBLE"]
        + [f"SELECT '{name}', '{c}', {f}({c}::DOUBLE) FROM wide" for c in _WIDE_NUMBERS for name, f in (("low", "min"), ("high", "max"))]
    ),
)
def report_from_parts(spark, sf_dir):
    """The report on events from the states of three parts, which were stored and merged."""
    events = sw.timestamp_features(table(spark, sf_dir, "events"))
    part = F.col("event_id") % 3
    states = sw.merge_states(_stored(spark, sw.table_states(events, part), "event-states"))
    values = sw.merge_values(_stored(spark, sw.value_states(events, part=part), "event-values"))
    parts = sw.report_of_states(states, values, "event_type")

    def lines(name: str, item, value, source: DataFrame) -> DataFrame:
        return source.select(F.lit(name).alias("issue"), F.col(item).alias("item"), value.cast("double").alias("value"))

    report = lines("missing", "column", F.col("missing_count"), parts["missing"])
    for more in (
        lines("skewness", "column", F.coalesce("skewness", "entropy"), parts["skewness"]),
        lines("high_skew", "column", F.col("skewness"), parts["high_skew"]),
        lines("rare", "column", F.col("outlier_count"), parts["outliers"].filter("type = 'Categorical'")),
        lines("low", "column", F.col("min"), parts["box"]),
        lines("high", "column", F.col("max"), parts["box"]),
        lines("classes", "class", F.col("n"), parts["classes"]),
        lines("imbalance", "event_type", F.col("imbalanced").cast("int"), parts["imbalance"].withColumn("event_type", F.lit("event_type"))),
    ):
        report = report.unionByName(more)
    return report


_COUNTED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query(
    "distinct_from_parts",
    sql.union(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_values, true AS within FROM orders""" for c in _COUNTED),
)
def distinct_from_parts(spark, sf_dir):
    """Whether the distinct values estimated from four parts' merged sketches are within the stated error of the count."""
    orders = table(spark, sf_dir, "orders").select(*_COUNTED)
    parts = _stored(spark, sw.table_states(orders, F.col("o_orderkey") % 4), "order-states")
    estimates = parts.sparkSession.createDataFrame(sw.merge_states(parts).select("column", F.hll_sketch_estimate("distinct").alias("e")).toArrow())
    exact = orders.agg(*[F.count_distinct(c).alias(c) for c in _COUNTED]).unpivot([], list(_COUNTED), "column", "n_values")
    both = exact.join(F.broadcast(estimates), "column")  # a row per column
    return both.select("column", "n_values", (F.abs(F.col("e") - F.col("n_values")) <= 0.05 * F.col("n_values")).alias("within"))
