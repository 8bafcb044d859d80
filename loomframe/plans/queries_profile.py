"""Queries over profiles, quality, semantic mapping, outliers, KPIs and chart data."""

from pyspark.sql import functions as F

from ..operators import mapping, outliers, profile, stats
from . import dirty
from .registry import query, table

_DUP = "(SELECT count(*) - count(DISTINCT (o_orderstatus, o_orderpriority)) FROM orders)"


@query("overview", f"""SELECT count(*) AS rows, 3 AS columns, count(*) FILTER (p IS NULL) AS null_cells, round_even(100.0 * count(*) FILTER (p IS NULL) / (count(*) * 3), 2) AS null_percent,
count(*) - count(DISTINCT (o_orderstatus, coalesce(p, '#'), c)) AS duplicates, 1 AS numeric_columns, 2 AS text_columns
FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS p, o_custkey % 2 AS c FROM orders)""")
def _(s, d):
    return profile.overview(table(s, d, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("p"), (F.col("o_custkey") % 2).alias("c")))


def _number(c, kind, src):
    return f"SELECT '{c}' AS \"column\", '{kind}' AS type, count({c}) AS non_null, count(*) - count({c}) AS missing, round_even(100.0 * (count(*) - count({c})) / count(*), 1) AS missing_percent, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, CAST(NULL AS VARCHAR) AS top FROM {src}"


def _other(c, kind, src):
    return f"SELECT '{c}', '{kind}', count({c}), count(*) - count({c}), round_even(100.0 * (count(*) - count({c})) / count(*), 1), NULL, NULL, NULL, (SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) FROM {src}"


@query("column_profile", " UNION ALL ".join([_number("event_id", "bigint", dirty.NULLS), _number("v", "double", dirty.NULLS), _other("event_type", "string", dirty.NULLS)]))
def _(s, d):
    return profile.column_profile(dirty.nulls(s, d).select("event_id", "v", "event_type"))


_BAD = f"(SELECT count(*) FILTER (t IS NOT NULL AND {dirty.NUM.format('t')} IS NULL) AS bad, count(*) FILTER (t IS NULL) AS empty, count(*) AS n FROM {dirty.MIXED})"


@query("quality_report", f"""SELECT 'rows' AS metric, '' AS "column", CAST(count(*) AS DOUBLE) AS value FROM lineitem
UNION ALL SELECT 'duplicates', '', CAST((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY ALL, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS DOUBLE)
UNION ALL SELECT 'score', '', round_even(100.0 * (count(*) * 11 - (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate))) / (count(*) * 11), 1) FROM lineitem""".replace("GROUP BY ALL, ", "GROUP BY "))
def _(s, d):
    return profile.quality_report(table(s, d, "lineitem"))


@query("quality_score", f"SELECT round_even(100.0 * (n * 2 - bad - empty) / (n * 2), 1) AS score FROM {_BAD}")
def _(s, d):
    return profile.quality_score(dirty.mixed(s, d))


@query("type_errors", f"SELECT 't' AS \"column\", bad AS errors FROM {_BAD} WHERE bad > 0")
def _(s, d):
    return profile.type_errors(dirty.mixed(s, d))


@query("future_dates", "SELECT 'o_orderdate' AS \"column\", count(*) FILTER (o_orderdate > TIMESTAMP '1997-01-01 00:00:00') AS future FROM orders")
def _(s, d):
    return profile.future_dates(table(s, d, "orders"), "1997-01-01 00:00:00")


@query("risk_level", "SELECT event_id, CASE WHEN value >= 85 THEN 'Low' WHEN value >= 60 THEN 'Medium' ELSE 'High' END AS risk FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", profile.risk_level(F.col("value")).alias("risk"))


@query("quality_snapshot", f"""WITH t AS (SELECT event_type, v FROM {dirty.NULLS}), k AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (v IS NULL) AS DOUBLE) AS e FROM t),
g AS (SELECT CAST(sum(c - 1) AS DOUBLE) AS x FROM (SELECT count(*) AS c FROM t GROUP BY event_type, v))
SELECT 'rows' AS item, '' AS "column", n AS value FROM k UNION ALL SELECT 'columns', '', 2.0 UNION ALL SELECT 'null_cells', '', e FROM k UNION ALL SELECT 'null_percent', '', round_even(100 * e / (n * 2), 2) FROM k
UNION ALL SELECT 'duplicates', '', x FROM g UNION ALL SELECT 'duplicate_percent', '', round_even(100 * x / n, 2) FROM g, k UNION ALL SELECT 'most_nulls', 'v', e FROM k WHERE e > 0""")
def _(s, d):
    return profile.quality_snapshot(dirty.nulls(s, d).select("event_type", "v"))


@query("table_summary_json")
def _(s, d):
    return profile.table_summary_json(table(s, d, "orders"), ["o_orderkey"])


@query("fingerprint")
def _(s, d):
    return profile.fingerprint(table(s, d, "orders"))


@query("categorical_cols", """SELECT * FROM (SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS distinct_values FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'c', count(DISTINCT o_custkey % 3) FROM orders)""")
def _(s, d):
    return profile.categorical_cols(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 3).alias("c")))


@query("date_like_cols", "SELECT 'd' AS \"column\", 'values' AS reason FROM orders LIMIT 1")
def _(s, d):
    return profile.date_like_cols(dirty.dates(s, d), "o_orderkey")


@query("category_share", "SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type ORDER BY n DESC, value LIMIT 3")
def _(s, d):
    return profile.category_share(table(s, d, "events"), "event_type")


@query("date_coverage", "SELECT 'ts' AS \"column\", CAST(min(ts) AS TIMESTAMP) AS first, CAST(max(ts) AS TIMESTAMP) AS last, count(ts) AS valid FROM events")
def _(s, d):
    return profile.date_coverage(table(s, d, "events"))


@query("kpi_candidates", """SELECT * FROM (SELECT 'o_orderkey' AS "column", CAST(min(o_orderkey) AS DOUBLE) AS low, CAST(max(o_orderkey) AS DOUBLE) AS high FROM orders UNION ALL SELECT 'o_custkey', min(o_custkey), max(o_custkey) FROM orders UNION ALL SELECT 'o_totalprice', min(o_totalprice), max(o_totalprice) FROM orders)""")
def _(s, d):
    return profile.kpi_candidates(table(s, d, "orders"))


def _outliers(c):
    return f"""SELECT 'outliers' AS finding, '{c}' AS subject, CAST(count(*) FILTER (x < q[1] - 1.5 * (q[2] - q[1]) OR x > q[2] + 1.5 * (q[2] - q[1])) AS DOUBLE) AS value
FROM (SELECT {c} AS x FROM {dirty.NULLS}), (SELECT quantile_cont({c}, [0.25, 0.75]) AS q, count({c}) AS n FROM {dirty.NULLS}) WHERE n >= 8 AND q[1] <> q[2] HAVING value > 0"""


_NUMBERS, _TEXTS = ("event_id", "user_id", "value", "v"), ("event_type", "props")
_DISTINCT = " UNION ALL ".join(f"SELECT '{c}' AS subject, count(DISTINCT {c}) AS k, count(*) AS n, {c in _TEXTS} AS words FROM {dirty.NULLS}" for c in (*_NUMBERS, *_TEXTS, "ts"))


@query(
    "findings",
    f"""SELECT 'nulls' AS finding, 'table' AS subject, CAST(count(*) FILTER (v IS NULL) AS DOUBLE) AS value FROM {dirty.NULLS} HAVING value > 0
UNION ALL {" UNION ALL ".join(f"SELECT 'kpi_candidate', '{c}', CAST(max({c}) AS DOUBLE) FROM {dirty.NULLS} HAVING min({c}) < max({c})" for c in _NUMBERS)}
UNION ALL {" UNION ALL ".join(map(_outliers, _NUMBERS))}
UNION ALL SELECT 'categorical', subject, CAST(k AS DOUBLE) FROM ({_DISTINCT}) WHERE words OR k <= least(30, greatest(5, 0.2 * n))
UNION ALL SELECT 'dates', 'ts', 1.0""",
)
def _(s, d):
    return profile.findings(dirty.nulls(s, d), "event_id")


# --- semantic mapping


def _catalog(s, d):
    return mapping.catalog_columns({t: table(s, d, t) for t in ("customer", "orders", "part", "events")})


_COLUMNS = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "events": "event_id ts user_id event_type value props",
}
_CATALOG = "(" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS filled FROM {t}" for t, cs in _COLUMNS.items() for c in cs.split()) + ")"
_WORDS = ", ".join(f"('{g}', '{w}', {n})" for n, (g, w) in enumerate((g, w) for g, ws in mapping.LEXICON.items() for w in ws))
_SCORED = f"""SELECT table_name, column_name, filled, g, k, o, CASE WHEN n = k THEN 1.0 WHEN starts_with(n, k) OR ends_with(n, k) THEN 0.85 WHEN contains(n, k) OR contains(k, n) THEN 0.65 ELSE 0.0 END AS score
FROM (SELECT table_name, column_name, filled, trim(regexp_replace(lower(column_name), '[_-]', ' ', 'g')) AS n FROM {_CATALOG}), (VALUES {_WORDS}) w(g, k, o)"""
_MAPPED = f"""SELECT table_name, column_name, filled, CASE WHEN score > 0 THEN g ELSE 'unknown' END AS semantic_group, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY score DESC, length(k) DESC, o) AS r FROM ({_SCORED})) WHERE r = 1"""
_LABEL = "CASE WHEN score >= 0.85 THEN 'auto_accepted' WHEN score >= 0.6 THEN 'verify' WHEN score >= 0.3 THEN 'suspicious' ELSE 'unknown' END"


def _mapped(s, d):
    return mapping.semantic_map(_catalog(s, d), mapping.lexicon(s))


@query("semantic_map", _MAPPED)
def _(s, d):
    return _mapped(s, d)


@query("mapping_label", f"SELECT table_name, column_name, filled, {_LABEL} AS label FROM ({_MAPPED})")
def _(s, d):
    return _mapped(s, d).select("table_name", "column_name", "filled", mapping.mapping_label(F.col("score")).alias("label"))


_PART = "100.0 * count(*) FILTER (label = '{0}') / count(*)"


@query("mapping_summary", f"""SELECT {", ".join(f"round_even({_PART.format(k)}, 1) AS {k}" for k in ('auto_accepted', 'verify', 'suspicious', 'unknown'))},
round_even({_PART.format('auto_accepted')} + 0.6 * {_PART.format('verify')} + 0.3 * {_PART.format('suspicious')}, 1) AS overall,
round_even(100.0 * sum(CASE WHEN score > 0 THEN filled ELSE 0 END) / sum(filled), 1) AS mapped_cells FROM (SELECT {_LABEL} AS label, score, filled FROM ({_MAPPED}))""")
def _(s, d):
    return mapping.mapping_summary(_mapped(s, d))


@query("mapping_override", f"""SELECT table_name, column_name, filled, CASE WHEN column_name = 'ts' THEN 'time' ELSE semantic_group END AS semantic_group, CASE WHEN column_name = 'ts' THEN 1.0 ELSE score END AS score,
column_name = 'ts' AS approved, column_name <> 'ts' AND score < 0.6 AS weak FROM ({_MAPPED})""")
def _(s, d):
    own = s.createDataFrame([("events", "ts", "time")], "table_name string, column_name string, semantic_group string")
    return mapping.mapping_override(_mapped(s, d), own)


@query("mask_pii", "SELECT c_custkey, '***' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(s, d):
    return mapping.mask_pii(table(s, d, "customer"))


# --- outliers


_V = f"(SELECT event_id, v FROM {dirty.NULLS})"
_Q = f"(SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, quantile_cont(v, 0.5) AS m, avg(v) AS mu, stddev_samp(v) AS sd FROM {_V})"
_OUT = "coalesce(v < a - 0.3 * (b - a) OR v > b + 0.3 * (b - a), false)"


def _nv(s, d):
    return dirty.nulls(s, d).select("event_id", "v")


@query("outlier_iqr", f"SELECT event_id, v, {_OUT} AS outlier FROM {_V}, {_Q}")
def _(s, d):
    return outliers.outlier_flag(_nv(s, d), "v", "iqr", 0.3)


@query("outlier_zscore", f"SELECT event_id, v, coalesce(v < mu - 1.5 * sd OR v > mu + 1.5 * sd, false) AS outlier FROM {_V}, {_Q}")
def _(s, d):
    return outliers.outlier_flag(_nv(s, d), "v", "zscore", 1.5)


@query("outlier_remove", f"SELECT event_id, v FROM {_V}, {_Q} WHERE NOT {_OUT}")
def _(s, d):
    return outliers.outlier_remove(_nv(s, d), "v", "iqr", 0.3)


@query("outlier_cap", f"SELECT event_id, round(CASE WHEN v < a - 0.3 * (b - a) THEN a - 0.3 * (b - a) WHEN v > b + 0.3 * (b - a) THEN b + 0.3 * (b - a) ELSE v END, 6) AS v FROM {_V}, {_Q}")
def _(s, d):
    return outliers.outlier_cap(_nv(s, d), "v", "iqr", 0.3).withColumn("v", F.round("v", 6))


@query("outlier_median", f"SELECT event_id, round(CASE WHEN {_OUT} THEN m ELSE v END, 6) AS v FROM {_V}, {_Q}")
def _(s, d):
    return outliers.outlier_median(_nv(s, d), "v", "iqr", 0.3).withColumn("v", F.round("v", 6))


@query("outlier_summary", """SELECT * FROM (SELECT 'w' AS "column", count(*) FILTER (w < a - 1.5 * (b - a) OR w > b + 1.5 * (b - a)) AS outliers, round_even(100.0 * count(*) FILTER (w < a - 1.5 * (b - a) OR w > b + 1.5 * (b - a)) / count(w), 2) AS percent
FROM (SELECT value * value * value AS w FROM events), (SELECT quantile_cont(value * value * value, 0.25) AS a, quantile_cont(value * value * value, 0.75) AS b FROM events)) WHERE outliers > 0""")
def _(s, d):
    return outliers.outlier_summary(table(s, d, "events").select((F.col("value") * F.col("value") * F.col("value")).alias("w")))


@query("outlier_list", f"SELECT event_id, v, (SELECT count(*) FILTER ({_OUT}) FROM {_V}, {_Q}) AS outliers, (SELECT round_even(100.0 * count(*) FILTER ({_OUT}) / count(*), 2) FROM {_V}, {_Q}) AS percent FROM {_V}, {_Q} WHERE {_OUT} ORDER BY event_id LIMIT 50")
def _(s, d):
    return outliers.outlier_list(_nv(s, d), "v", ["event_id"], "iqr", 0.3)


# --- KPIs and chart data


@query("kpi_value", "SELECT round(sum(o_totalprice), 2) AS value FROM orders")
def _(s, d):
    return stats.kpi_value(table(s, d, "orders"), "o_totalprice", "Total")


@query("kpi_achievement", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE round_even(100.0 * event_id / (event_id % 5), 1) END AS achievement FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", stats.achievement(F.col("event_id"), F.col("event_id") % 5).alias("achievement"))


_KPI = "SELECT '{0}' AS kpi, round(CAST({1} AS DOUBLE), 2) AS current, {2} AS annual, {2} / 4 AS quarterly, round_even(100.0 * round(CAST({1} AS DOUBLE), 2) / {2}, 1) AS achievement FROM orders"


@query("kpi_report", f"SELECT *, CASE WHEN achievement >= 100 THEN 'Met' WHEN achievement >= 70 THEN 'On Track' ELSE 'Below' END AS status FROM ({_KPI.format('o_totalprice', 'avg(o_totalprice)', '300000.0::DOUBLE')} UNION ALL {_KPI.format('o_custkey', 'max(o_custkey)', '100.0::DOUBLE')})")
def _(s, d):
    return stats.kpi_report(table(s, d, "orders"), {"o_totalprice": {"annual": 300_000, "agg": "Mean"}, "o_custkey": {"annual": 100, "agg": "Max"}})


@query("kpi_trend", f"SELECT ts AS date, v AS value FROM {dirty.NULLS} WHERE v IS NOT NULL")
def _(s, d):
    return stats.kpi_trend(dirty.nulls(s, d), "ts", "v")


_TOP = "SELECT p_brand AS key, round(sum(p_retailprice), 2) AS total FROM part GROUP BY p_brand ORDER BY total DESC, key LIMIT 10"


@query("top_n_sum", _TOP)
def _(s, d):
    return stats.top_n_sum(table(s, d, "part"), "p_brand", "p_retailprice", 10)


@query("pie_top_n", f"SELECT key, total, round(total / sum(total) OVER (), 6) AS share FROM ({_TOP})")
def _(s, d):
    return stats.pie_top_n(table(s, d, "part"), "p_brand", "p_retailprice", 10)


@query("histogram", "SELECT CAST(bin AS INTEGER) AS bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high, count(*) AS n FROM (SELECT least(floor((value - lo) / w), 9) AS bin, lo, w FROM events, (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM events)) GROUP BY bin, lo, w")
def _(s, d):
    return stats.histogram(table(s, d, "events"), "value", 10)


@query("line_series", "SELECT ts AS x, value AS y FROM events")
def _(s, d):
    return stats.line_series(table(s, d, "events"), "ts", "value")


@query("scatter_xy", "SELECT p_size AS x, p_retailprice AS y, p_brand AS colour FROM part")
def _(s, d):
    return stats.scatter_xy(table(s, d, "part"), "p_size", "p_retailprice", "p_brand")


@query("box_stats", "SELECT event_type AS grp, count(value) AS n, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max FROM events GROUP BY event_type")
def _(s, d):
    return stats.box_stats(table(s, d, "events"), "value", "event_type")


@query("correlation", f"SELECT 'v' AS a, 'w' AS b, round(corr(v, w), 6) AS r FROM (SELECT *, event_id % 13 AS w FROM {dirty.NULLS}) UNION ALL SELECT 'v', 'c', NULL UNION ALL SELECT 'w', 'c', NULL")
def _(s, d):
    return stats.correlation(dirty.nulls(s, d).select("v", (F.col("event_id") % 13).alias("w"), F.lit(7).alias("c")), ["v", "w", "c"])


@query("distribution", "SELECT 'value' AS \"column\", count(value) AS n, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{int(100 * p):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM events")
def _(s, d):
    return stats.distribution(table(s, d, "events"), ["value"])
