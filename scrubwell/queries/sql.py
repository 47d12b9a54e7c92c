"""Pieces of the comparison SQL."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

SEED = 42


def rounded(expr: str, digits: int = 3) -> str:
    """Rounding that never yields a negative zero."""
    return f"CASE WHEN abs({expr}) < 0.5 * pow(10, -{digits}) THEN 0.0 ELSE round({expr}, {digits}) END"


def union(parts: Iterable[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def skewness(column: str, table: str) -> str:
    """Population skewness from centred moments."""
    m = f"(SELECT avg({column}::DOUBLE) FROM {table})"
    d = f"({column}::DOUBLE - {m})"
    return f"(SELECT CASE WHEN count(DISTINCT {column}) > 1 THEN avg(pow({d}, 3)) / pow(avg({d} * {d}), 1.5) END FROM {table})"


def entropy(column: str, table: str) -> str:
    return (
        f"(SELECT -sum(p * log2(p)) FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM {table}) AS p "
        f"FROM {table} GROUP BY {column}))"
    )


def rare_values(column: str, table: str) -> str:
    return (
        f"(SELECT count(*) FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM {table}) AS p "
        f"FROM {table} GROUP BY {column}) WHERE p < 0.1)"
    )


def skewness_lines(table: str, numbers: Sequence[str], strings: Sequence[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", 'Numeric' AS type, {rounded(skewness(c, table))} AS skewness, NULL::DOUBLE AS entropy"""
        for c in numbers
    ]
    parts += [
        f"""SELECT '{c}' AS "column", 'Categorical' AS type, NULL::DOUBLE AS skewness, {rounded(entropy(c, table))} AS entropy"""
        for c in strings
    ]
    return union(parts)


def outlier_lines(table: str, numbers: Sequence[str], strings: Sequence[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", 'Numeric' AS type,
  (SELECT count(*) FROM {table} WHERE {c} < q1 - 5 * (q3 - q1) OR {c} > q3 + 5 * (q3 - q1)) AS outlier_count,
  {rounded('q1', 2)} AS q1, {rounded('q3', 2)} AS q3,
  {rounded('q1 - 5 * (q3 - q1)', 2)} AS lower_bound, {rounded('q3 + 5 * (q3 - q1)', 2)} AS upper_bound
FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {table})"""
        for c in numbers
    ]
    parts += [
        f"""SELECT '{c}' AS "column", 'Categorical' AS type, {rare_values(c, table)} AS outlier_count,
  NULL::DOUBLE AS q1, NULL::DOUBLE AS q3, NULL::DOUBLE AS lower_bound, NULL::DOUBLE AS upper_bound"""
        for c in strings
    ]
    return union(parts)


def digest(columns: Sequence[str], seed: int = SEED) -> str:
    cells = [
        f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, 'N')" for c in columns
    ]
    return f"md5('{seed}|' || " + " || ".join(cells) + ")"


def hex_number(text: str, digits: int) -> str:
    return f"('0x' || substr({text}, 1, {digits}))::BIGINT"


def ranks(table: str, column: str) -> str:
    """``(v, x)``: values by falling frequency, ties in value order, from 0."""
    return (
        f"(SELECT {column} AS v, (row_number() OVER (ORDER BY count(*) DESC, {column}) - 1)::DOUBLE AS x "
        f"FROM {table} WHERE {column} IS NOT NULL GROUP BY {column})"
    )


def correlation_lines(table: str, target: str, numbers: Sequence[str], strings: Sequence[str], ranked_target: bool = False) -> str:
    y = "y.x" if ranked_target else f"t.{target}::DOUBLE"
    join_y = f" JOIN {ranks(table, target)} y ON t.{target} = y.v" if ranked_target else ""
    parts = [f"SELECT '{c}' AS feature, corr(t.{c}::DOUBLE, {y}) AS r FROM {table} t{join_y}" for c in numbers]
    parts += [
        f"SELECT '{c}' AS feature, corr(f.x, {y}) AS r FROM {table} t{join_y} JOIN {ranks(table, c)} f ON t.{c} = f.v"
        for c in strings
    ]
    return f"SELECT feature, {rounded('r')} AS correlation FROM ({union(parts)}) WHERE r IS NOT NULL AND NOT isnan(r)"


def regression_tree(category: str, number: str, target: str, depth: int = 5, bins: int = 64) -> str:
    """CTEs ``cells`` (training rows by bin and number) to ``guesses`` (label and prediction of each test row), after a CTE
    ``parted`` with ``train``: categories in bins by mean target, and a tree that cuts both features where that lowers the
    squared error the most, level by level."""
    steps = [
        f"""values_ AS (SELECT {category} AS v, count(*) AS n, sum({target}) AS s FROM parted WHERE train GROUP BY v)""",
        f"""placed AS (SELECT *, row_number() OVER w - 1 AS place, sum(n) OVER w - n AS before, count(*) OVER () AS k, sum(n) OVER () AS total
  FROM values_ WINDOW w AS (ORDER BY s / n, v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        f"""binned AS (SELECT v, n, s, (CASE WHEN k <= {bins} THEN place ELSE (2 * before + n) * {bins} // (2 * total) END)::DOUBLE AS bin FROM placed)""",
        """unseen AS (SELECT min(bin) - 0.5 AS bin FROM (SELECT bin, sum(s) / sum(n) AS m FROM binned GROUP BY bin)
  WHERE m >= (SELECT sum(s) / sum(n) FROM binned))""",
        f"""spots AS (SELECT train, coalesce(b.bin, (SELECT bin FROM unseen)) AS x1, {number}::DOUBLE AS x2, {target} AS y
  FROM parted LEFT JOIN binned b ON b.v = {category})""",
        """cuts AS (SELECT 1 AS f, x, (x + lead(x) OVER (ORDER BY x)) / 2 AS cut FROM (SELECT DISTINCT x1 AS x FROM spots WHERE train)
  UNION ALL SELECT 2, x, (x + lead(x) OVER (ORDER BY x)) / 2 FROM (SELECT DISTINCT x2 AS x FROM spots WHERE train))""",
        "node0 AS (SELECT *, 1 AS node FROM spots)",
    ]
    for level in range(depth):
        steps += [
            f"""sums{level} AS (SELECT node, f, x, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER (PARTITION BY node, f) AS n_all, sum(s) OVER (PARTITION BY node, f) AS s_all
  FROM (SELECT node, 1 AS f, x1 AS x, count(*) AS n, sum(y) AS s FROM node{level} WHERE train GROUP BY node, x1
        UNION ALL SELECT node, 2, x2, count(*), sum(y) FROM node{level} WHERE train GROUP BY node, x2)
  WINDOW w AS (PARTITION BY node, f ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
            f"""best{level} AS (SELECT node, f, cut FROM sums{level} JOIN cuts USING (f, x)
  WHERE n < n_all AND s * s / n + (s_all - s) * (s_all - s) / (n_all - n) > s_all * s_all / n_all
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY s * s / n + (s_all - s) * (s_all - s) / (n_all - n) DESC, f, x) = 1)""",
            f"""node{level + 1} AS (SELECT t.* EXCLUDE (node), CASE WHEN b.f IS NULL THEN t.node
    WHEN (CASE b.f WHEN 1 THEN x1 ELSE x2 END) <= b.cut THEN 2 * t.node ELSE 2 * t.node + 1 END AS node
  FROM node{level} t LEFT JOIN best{level} b USING (node))""",
        ]
    steps += [
        f"leaves AS (SELECT node, avg(y) AS prediction FROM node{depth} WHERE train GROUP BY node)",
        f"guesses AS (SELECT y AS label, prediction FROM node{depth} JOIN leaves USING (node) WHERE NOT train)",
    ]
    return ",\n".join(steps)
