"""Queries over cleaning, filters, nulls and conversion."""

from pyspark.sql import functions as F

from ..operators import clean, convert, filters
from ..operators import nulls as fill
from . import dirty, importing
from .registry import query, table


@query("clean_names", """SELECT r_regionkey AS region, r_name AS column_2, CAST(r_regionkey AS BIGINT) AS region_2 FROM region""")
def _(s, d):
    return clean.clean_names(table(s, d, "region").select("r_regionkey", "r_name", F.col("r_regionkey").cast("long")).toDF(" region", "Unnamed: 0", "region "))


@query("strip_strings", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trim(f, ' ' || chr(9)) AS f FROM {dirty.PADDED}")
def _(s, d):
    return clean.strip_strings(dirty.padded(s, d))


@query("fake_nulls", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN lower(trim(f)) IN ('n/a', '-') THEN NULL ELSE f END AS f FROM {dirty.PADDED}")
def _(s, d):
    return clean.fake_nulls(dirty.padded(s, d))


@query("fake_nulls_page", f"SELECT l_orderkey, CASE WHEN lower(trim(f)) IN ('n/a', '-') OR l_partkey % 11 = 0 THEN NULL ELSE f END AS f FROM {dirty.PADDED}")
def _(s, d):
    df = dirty.padded(s, d).select("l_orderkey", F.when(F.col("l_partkey") % 11 == 0, " Missing ").otherwise(F.col("f")).alias("f"))
    return clean.fake_nulls(df, values=clean.FAKE_NULLS_PAGE)


@query("bool_standardise", f"SELECT event_id, CASE b WHEN 'Y' THEN 'Yes' WHEN 'no' THEN 'No' ELSE b END AS b FROM {dirty.YESNO}")
def _(s, d):
    return clean.bool_standardise(dirty.yesno(s, d))


@query("date_detect", f"SELECT o_orderkey, CAST(try_strptime(d, '%d/%m/%Y') AS TIMESTAMP) AS d FROM {dirty.DATES}")
def _(s, d):
    return clean.date_detect(dirty.dates(s, d), order_by="o_orderkey")


@query("drop_empty_rows", f"SELECT a, e FROM {dirty.HOLES} WHERE a IS NOT NULL OR e IS NOT NULL")
def _(s, d):
    return clean.drop_empty_rows(dirty.holes(s, d))


@query("drop_empty_cols", f"SELECT a FROM {dirty.HOLES}")
def _(s, d):
    return clean.drop_empty_cols(dirty.holes(s, d))


_STEPS = f"""
SELECT * FROM (
  SELECT 'strip' AS action, 'f' AS detail, count(*) FILTER (f <> trim(f, ' ' || chr(9))) AS n, 'info' AS severity FROM {dirty.PADDED}
  UNION ALL SELECT 'fake_nulls', 'f', count(*) FILTER (lower(trim(f)) IN ('n/a', '-')), 'warning' FROM {dirty.PADDED}) WHERE n > 0"""


@query("cleaning_report", _STEPS)
def _(s, d):
    return clean.cleaning_report(dirty.padded(s, d))


@query("import_pipeline", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN lower(trim(f)) IN ('n/a', '-') THEN NULL ELSE trim(f, ' ' || chr(9)) END AS f FROM {dirty.PADDED}")
def _(s, d):
    return importing.import_pipeline(dirty.padded(s, d), "lineitem")["data"]


@query("search_all", "SELECT * FROM customer WHERE lower(CAST(c_custkey AS VARCHAR)) LIKE '%auto%' OR lower(c_name) LIKE '%auto%' OR lower(CAST(c_nationkey AS VARCHAR)) LIKE '%auto%' OR lower(c_mktsegment) LIKE '%auto%'")
def _(s, d):
    return filters.search_all(table(s, d, "customer"), "Auto")


@query("search_col", "SELECT * FROM part WHERE contains(lower(p_name), 'a')")
def _(s, d):
    return filters.search_col(table(s, d, "part"), "p_name", "A")


@query("filter_cmp", f"SELECT event_id, v FROM {dirty.NULLS} WHERE v IS DISTINCT FROM 10 AND event_id >= 50")
def _(s, d):
    df = dirty.nulls(s, d).select("event_id", "v")
    return filters.filter_by(filters.filter_by(df, "v", "!=", 10), "event_id", ">=", 50)


@query("filter_between", "SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def _(s, d):
    return filters.filter_by(table(s, d, "lineitem"), "l_quantity", "between", (10, 20))


@query("filter_text", f"SELECT l_orderkey, l_linenumber, f FROM (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE f END AS g FROM {dirty.PADDED}) WHERE (g IS NULL OR NOT contains(lower(g), 'r')) AND starts_with(f, '  ')")
def _(s, d):
    df = dirty.padded(s, d).withColumn("g", F.when(F.col("l_orderkey") % 3 != 0, F.col("f")))
    return filters.filter_by(filters.filter_by(df, "g", "not contains", "R"), "f", "starts with", "  ").select("l_orderkey", "l_linenumber", "f")


@query("filter_multi", "SELECT * FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'high')")
def _(s, d):
    return filters.filter_multi(table(s, d, "orders"), [("o_totalprice", ">", "1000"), ("o_orderstatus", "==", "O"), ("nowhere", "==", 1), ("o_orderpriority", "contains", "high")])


@query("filter_dict", "SELECT * FROM part WHERE p_size BETWEEN 5 AND 15 AND p_retailprice >= 900")
def _(s, d):
    return filters.filter_dict(table(s, d, "part"), {"p_size": {"op": "between", "value": (5, 15)}, "p_retailprice": {"op": "ge", "value": 900}})


@query("filter_in", "SELECT * FROM customer WHERE c_nationkey IN (1, 5, 9)")
def _(s, d):
    return filters.filter_by(table(s, d, "customer"), "c_nationkey", "in", [1, 5, 9])


_NULL_SUMMARY = f"SELECT 'v' AS \"column\", count(*) FILTER (v IS NULL) AS missing, round_even(100.0 * count(*) FILTER (v IS NULL) / count(*), 1) AS percent FROM {dirty.NULLS} HAVING count(*) FILTER (v IS NULL) > 0"


@query("null_summary", _NULL_SUMMARY)
def _(s, d):
    return fill.null_summary(dirty.nulls(s, d))


@query("null_severity", f"SELECT *, CASE WHEN percent > 30 THEN 'High' WHEN percent > 10 THEN 'Medium' ELSE 'Low' END AS severity FROM ({_NULL_SUMMARY})")
def _(s, d):
    return fill.null_severity(dirty.nulls(s, d))


def _v(s, d):
    return dirty.nulls(s, d).select("event_id", "v")


@query("fill_const", f"SELECT CAST(event_id AS DOUBLE) AS event_id, coalesce(v, -1.0) AS v FROM {dirty.NULLS}")
def _(s, d):
    return fill.fill_const(_v(s, d), -1.0)


@query("fill_custom", f"SELECT o_orderkey, coalesce({dirty.NUM.format('t')}, 0.5) AS t FROM {dirty.MIXED}")
def _(s, d):
    return fill.fill_custom(dirty.mixed(s, d), ["t"], 0.5, as_number=True)


@query("fill_mean", f"SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM {dirty.NULLS})), 6) AS v FROM {dirty.NULLS}")
def _(s, d):
    return fill.fill_mean(_v(s, d), ["v"]).withColumn("v", F.round("v", 6))


@query("fill_median", f"SELECT event_id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM {dirty.NULLS})), 6) AS v FROM {dirty.NULLS}")
def _(s, d):
    return fill.fill_median(_v(s, d), ["v"]).withColumn("v", F.round("v", 6))


@query("fill_mode", """WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS k FROM events)
SELECT event_id, coalesce(k, (SELECT k FROM t WHERE k IS NOT NULL GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)) AS k FROM t""")
def _(s, d):
    return fill.fill_mode(table(s, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("k")), ["k"])


@query("fill_forward", f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM {dirty.NULLS}")
def _(s, d):
    return fill.fill_forward(dirty.nulls(s, d).select("event_id", "ts", "v"), "v", "ts").select("event_id", "v")


@query("fill_backward", f"SELECT event_id, user_id, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM {dirty.NULLS}")
def _(s, d):
    return fill.fill_backward(dirty.nulls(s, d).select("event_id", "user_id", "ts", "v"), "v", "ts", ["user_id"]).select("event_id", "user_id", "v")


@query("drop_any_null", f"SELECT * FROM {dirty.NULLS} WHERE v IS NOT NULL")
def _(s, d):
    return fill.drop_any_null(dirty.nulls(s, d))


@query("type_table", f"""SELECT * FROM (SELECT 'o_orderkey' AS "column", 'bigint' AS type, count(o_orderkey) AS non_null, count(*) - count(o_orderkey) AS missing, count(DISTINCT o_orderkey) AS distinct_values FROM {dirty.MIXED}
UNION ALL SELECT 't', 'string', count(t), count(*) - count(t), count(DISTINCT t) FROM {dirty.MIXED})""")
def _(s, d):
    return convert.type_table(dirty.mixed(s, d))


@query("cast_int", f"SELECT o_orderkey, coalesce(CAST(trunc({dirty.NUM.format('t')}) AS BIGINT), 0) AS t FROM {dirty.MIXED}")
def _(s, d):
    return convert.cast_int(dirty.mixed(s, d), "t")


@query("cast_float", f"SELECT o_orderkey, {dirty.NUM.format('t')} AS t FROM {dirty.MIXED}")
def _(s, d):
    return convert.cast_float(dirty.mixed(s, d), "t")


@query("coerce_numeric", f"SELECT o_orderkey, {dirty.NUM.format('t')} AS t FROM {dirty.MIXED}")
def _(s, d):
    return convert.coerce_numeric(dirty.mixed(s, d), ["t"])


@query("cast_text", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders")
def _(s, d):
    return convert.cast_text(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("category_dict", "SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code, p_brand AS value FROM (SELECT DISTINCT p_brand FROM part)")
def _(s, d):
    return convert.category_dict(table(s, d, "part"), "p_brand")


@query("cast_datetime", f"SELECT o_orderkey, CAST(try_strptime(d, '%d/%m/%Y') AS TIMESTAMP) AS d FROM {dirty.DATES}")
def _(s, d):
    return convert.cast_datetime(dirty.dates(s, d), "d", "%d/%m/%Y")


@query("cast_date", f"SELECT o_orderkey, CAST(try_strptime(d, '%d/%m/%Y') AS DATE) AS d FROM {dirty.DATES}")
def _(s, d):
    return convert.cast_date(dirty.dates(s, d), "d")


@query("cast_time", "SELECT event_id, strftime(ts, '%H:%M:%S') AS ts FROM events")
def _(s, d):
    return convert.cast_time(table(s, d, "events").select("event_id", "ts"), "ts")


@query("cast_bool", f"SELECT event_id, b IN ('y', 'yes', 'true', '1') AS b FROM (SELECT event_id, lower(b) AS b FROM {dirty.YESNO})")
def _(s, d):
    return convert.cast_bool(dirty.yesno(s, d).withColumn("b", F.lower("b")), "b")


@query("extract_number", "SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '[0-9.]+'), '') AS DOUBLE) AS props FROM events")
def _(s, d):
    return convert.extract_number(table(s, d, "events").select("event_id", "props"), "props")


@query("extract_date_text", f"SELECT o_orderkey, nullif(regexp_extract(d, '[0-9]{{1,4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,4}}'), '') AS d FROM {dirty.DATES}")
def _(s, d):
    return convert.extract_date_text(dirty.dates(s, d), "d")


@query("text_case", "SELECT p_partkey, upper(p_name) AS p_name, lower(p_type) AS p_type FROM part")
def _(s, d):
    return convert.text_case(convert.text_case(table(s, d, "part").select("p_partkey", "p_name", "p_type"), "p_name", "upper"), "p_type", "lower")


@query("text_title", "SELECT o_orderkey, array_to_string(list_transform(regexp_extract_all(lower(o_orderpriority), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') AS o_orderpriority FROM orders")
def _(s, d):
    return convert.text_title(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("keep_arabic", "SELECT p_partkey, trim(regexp_replace(concat(p_name, ' قطعة غيار '), '[^\\x{0600}-\\x{06FF}\\s]', '', 'g')) AS t FROM part")
def _(s, d):
    df = table(s, d, "part").select("p_partkey", F.concat("p_name", F.lit(" قطعة غيار ")).alias("t"))
    return convert.keep_arabic(df, "t")


@query("remove_special", "SELECT o_orderkey, trim(regexp_replace(o_orderpriority, '[^a-zA-Z0-9\\s]', '', 'g')) AS o_orderpriority FROM orders")
def _(s, d):
    return convert.remove_special(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")
