"""Queries over sources, SQL, editing and feature engineering."""

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import edit, features
from ..sources import readers, sinks
from ..streaming import rowlocal
from . import dirty
from .registry import query, table


def scratch(spark, name):
    """A fresh path in the folder that the cluster shares (a temporary folder of this machine on a local master)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("src_csv", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def _(s, d):
    path = scratch(s, "part.csv")
    sinks.write_csv(table(s, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return readers.read_csv(s, path, schema="p_partkey bigint, p_name string, p_size int, p_retailprice double")


@query("src_jsonl", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(s, d):
    path = scratch(s, "supplier.json")
    sinks.write_json(table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return readers.read_jsonl(s, path, "s_suppkey bigint, s_name string, s_acctbal double")


def _document_of_json(s, d):
    """One JSON document with regions and nations as arrays."""
    n = table(s, d, "nation").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", F.struct("n_name").alias("nation")))).alias("nations"))
    r = table(s, d, "region").agg(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("regions"))
    path = scratch(s, "world.json")
    n.crossJoin(r).write.json(path)
    return path


@query("src_json_doc", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS nation_n_name FROM nation")
def _(s, d):
    return readers.read_json_doc(s, _document_of_json(s, d), "nations").withColumnRenamed("nation.n_name", "nation_n_name")


@query("json_array_candidates", "SELECT 'regions' AS name, count(*) AS length FROM region UNION ALL SELECT 'nations', count(*) FROM nation")
def _(s, d):
    return readers.json_array_candidates(s.read.option("multiLine", True).json(_document_of_json(s, d)))


@query("flatten_struct", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events""")
def _(s, d):
    return readers.flatten(table(s, d, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))).withColumnRenamed("props.k", "props_k")


@query("src_parquet", "SELECT * FROM lineitem")
def _(s, d):
    return readers.read_parquet(s, f"{d}/lineitem.parquet")


@query("jdbc_select", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def _(s, d):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1).write.format("jdbc").options(url=url, dbtable="nation").save()
    df, _ = readers.read_jdbc(s, url, 'SELECT "n_nationkey", "n_name" FROM nation WHERE "n_regionkey" = 1', most=200_000)
    return df


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS name, 'table' AS kind, count(*) AS rows FROM {t}" for t in _TABLES)


@query("table_inventory", _COUNTS)
def _(s, d):
    return readers.table_inventory({t: table(s, d, t) for t in _TABLES})


@query("largest_table", f"SELECT * FROM ({_COUNTS}) ORDER BY rows DESC, name LIMIT 1")
def _(s, d):
    return readers.largest_table({t: table(s, d, t) for t in _TABLES})


_LINES = """(SELECT concat('f', CAST(o_orderkey // 20 AS VARCHAR)) AS file, CAST(o_orderkey % 20 AS INTEGER) AS line,
CASE WHEN o_orderkey % 20 = o_orderkey // 20 % 7 THEN ['name', 'price', 'when'] ELSE [o_orderstatus, CAST(o_totalprice AS VARCHAR), CAST(o_custkey AS VARCHAR)] END AS cells FROM orders)"""
_NUMERIC = "len(list_filter(cells, lambda x: regexp_matches(x, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')))"


@query(
    "header_row",
    f"""SELECT file, line AS header_line FROM (SELECT file, line, row_number() OVER (PARTITION BY file ORDER BY round(2.0 * (3 - num) / 3 + 1.5 * len(list_distinct(cells)) / 3 - 2.0 * num / 3 + 1.0, 9) DESC, line) AS r
FROM (SELECT *, {_NUMERIC} AS num FROM {_LINES} WHERE line < 15)) WHERE r = 1""",
)
def _(s, d):
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    file, line = F.expr("o_orderkey div 20"), (k % 20).cast("int")
    cells = F.when(line == file % 7, F.array(F.lit("name"), F.lit("price"), F.lit("when"))).otherwise(F.array("o_orderstatus", F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string")))
    return readers.header_row(o.select(F.concat(F.lit("f"), file.cast("string")).alias("file"), line.alias("line"), cells.alias("cells")))


@query(
    "file_audit",
    """SELECT 'csv' AS suffix, 'ok' AS verdict, count(DISTINCT c_nationkey) AS files FROM customer UNION ALL SELECT 'parquet', 'ok', count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'txt', 'empty', 1 UNION ALL SELECT 'txt', 'wrong content', count(DISTINCT r_regionkey) FROM region""",
)
def _(s, d):
    path = scratch(s, "landing")
    table(s, d, "customer").repartition("c_nationkey").write.partitionBy("c_nationkey").csv(f"{path}/a", header=True)
    table(s, d, "orders").repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(f"{path}/b")
    table(s, d, "region").select("r_regionkey", F.concat(F.lit("PK\u0003\u0004"), F.col("r_name"))).repartition("r_regionkey").write.partitionBy("r_regionkey").text(f"{path}/c")
    table(s, d, "region").select("r_name").where("false").coalesce(1).write.text(f"{path}/d")
    return readers.file_audit(s, path).groupBy("suffix", "verdict").agg(F.count("*").alias("files"))


@query("header_of_files", "SELECT concat('f', CAST(c_nationkey AS VARCHAR)) AS file, CAST(c_nationkey % 7 AS INTEGER) AS header_line FROM customer GROUP BY c_nationkey")
def _(s, d):
    """A CSV file a nation: title lines, a header, customers; names hold separators and line ends inside quotes."""
    c, k = table(s, d, "customer"), F.col("c_nationkey")
    data = c.select(k.alias("n"), (F.col("c_custkey") + 100).alias("at"), F.concat(F.lit('"'), "c_name", F.lit(', Ltd.\n",'), F.col("c_acctbal").cast("string"), F.lit(","), F.col("c_custkey").cast("string")).alias("value"))
    titles = F.concat(F.when(k % 7 > 0, F.sequence(F.lit(0), k % 7 - 1)).otherwise(F.array().cast("array<int>")), F.array(F.lit(50)))
    heads = c.select("c_nationkey").distinct().select(k.alias("n"), F.explode(titles).alias("at")).select("n", F.col("at").cast("long"), F.when(F.col("at") == 50, F.lit('name,"balance, total",number')).otherwise('"Report, page 1",,').alias("value"))
    path = scratch(s, "grid")
    data.unionByName(heads).repartition("n").sortWithinPartitions("n", "at").select("n", "value").write.partitionBy("n").text(path)
    found = readers.header_row(readers.csv_cells(s, path))
    return found.select(F.concat(F.lit("f"), F.regexp_extract("file", "n=([0-9]+)", 1)).alias("file"), "header_line")


@query(
    "database_catalog",
    """SELECT 'nation' AS name, 'table' AS kind, count(*) AS rows FROM nation UNION ALL SELECT 'customer', 'table', count(*) FROM customer UNION ALL SELECT 'supplier', 'table', count(*) FROM supplier
UNION ALL SELECT 'RICH', 'view', count(*) FROM customer WHERE c_acctbal > 5000""",
)
def _(s, d):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    for t in ("nation", "customer", "supplier"):
        table(s, d, t).coalesce(1).write.format("jdbc").options(url=url, dbtable=f'"{t}"', batchsize=5000).save()
    con = s.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    con.createStatement().execute('CREATE VIEW rich AS SELECT * FROM "customer" WHERE "c_acctbal" > 5000')
    con.close()
    return readers.database_catalog(s, url)


def _sql(name, text, duck=None):
    tables = [t for t in _TABLES if t in text]

    @query(name, duck or text)
    def _(s, d):
        return readers.sql_select(s, text, {t: table(s, d, t) for t in tables})


_sql("sql_select", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
_sql("sql_join", "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
_sql("sql_anti_join", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
_sql("sql_semi_join", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
_sql("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("sql_window", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS recent FROM events", "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS nth, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS recent FROM events")
_sql("sql_set_ops", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0 UNION SELECT n_nationkey FROM nation INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0 UNION (SELECT n_nationkey FROM nation INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")


@query("sink_csv", "SELECT count(*) AS rows FROM customer")
def _(s, d):
    path = scratch(s, "customer.csv")
    sinks.write_csv(table(s, d, "customer"), path)
    return s.read.csv(path, header=True, schema="c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").agg(F.count("*").alias("rows"))


@query("sink_json", "SELECT * FROM customer")
def _(s, d):
    path, df = scratch(s, "customer.json"), table(s, d, "customer")
    sinks.write_json(df, path)
    return s.read.schema(df.schema).json(path)


@query("export_summary", f"SELECT count(*) AS rows, 7 AS columns, count(*) FILTER (v IS NULL) AS null_cells FROM {dirty.NULLS}")
def _(s, d):
    return sinks.export_summary(dirty.nulls(s, d))


# --- replace, compute, delete, sort, deduplicate


@query("replace_all", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(s, d):
    return edit.replace_all(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "O, P", "open")


@query("replace_regex_all", "SELECT p_partkey, regexp_replace(p_brand, '#([0-9])', '-\\1', 'g') AS p_brand FROM part")
def _(s, d):
    return edit.replace_regex_all(table(s, d, "part").select("p_partkey", "p_brand"), "#([0-9])", r"-\1")


@query("replace_exact_col", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'seen' ELSE event_type END AS event_type FROM events")
def _(s, d):
    return edit.replace_exact_col(table(s, d, "events").select("event_id", "event_type"), "event_type", ["click", "view"], "seen")


@query("replace_regex_col", "SELECT p_partkey, regexp_replace(regexp_replace(p_type, '[aeiou]+', '_', 'g'), '[A-Z]', '_', 'g') AS p_type FROM part")
def _(s, d):
    return edit.replace_regex_col(table(s, d, "part").select("p_partkey", "p_type"), "p_type", ["[aeiou]+", "[A-Z]"], "_")


@query("renumber", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS t FROM orders")
def _(s, d):
    return edit.renumber(table(s, d, "orders").select("o_orderkey", F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("t")), "t")


@query("computed_col", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) / nullif(l_quantity, 0) + power(l_tax, 2) AS unit, l_quantity > 10 AND l_tax < 0.05 AS big, CAST(floor(l_quantity / 7) AS BIGINT) AS weeks, l_quantity % 7 AS rest, power(2, power(l_linenumber % 3, 3)) AS tower FROM lineitem")
def _(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_quantity", "l_tax", "l_linenumber")
    df = edit.computed_col(df, "unit", "l_extendedprice * (1 - l_discount) / `l_quantity` + l_tax ** 2")
    df = edit.computed_col(df, "big", "(l_quantity > 10) & (l_tax < 0.05)")
    df = edit.computed_col(edit.computed_col(df, "weeks", "l_quantity // 7"), "rest", "l_quantity % 7")
    df = edit.computed_col(df, "tower", "2 ** (l_linenumber % 3) ** 3")
    return df.select("l_orderkey", "unit", "big", "weeks", "rest", "tower")


@query("drop_col", "SELECT * EXCLUDE (c_name) FROM customer")
def _(s, d):
    return edit.drop_col(table(s, d, "customer"), "c_name")


@query("rename_col", "SELECT c_custkey, c_name AS client, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(s, d):
    return edit.rename_col(table(s, d, "customer"), "c_name", "client")


@query("delete_row", "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r <> 6")
def _(s, d):
    return edit.delete_row(table(s, d, "events"), 5, ["event_id"])


@query("preview", "SELECT * FROM events ORDER BY event_id LIMIT 20")
def _(s, d):
    return edit.preview(table(s, d, "events"), ["event_id"], 20)


@query("dedupe_full", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(s, d):
    return edit.dedupe_full(table(s, d, "orders").select("o_orderstatus", "o_orderpriority"))


@query("dedupe_subset", "SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def _(s, d):
    return edit.dedupe_subset(table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])


@query("dup_count", "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, round_even(100.0 * sum(n - 1) / sum(n), 2) AS percent FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)")
def _(s, d):
    return edit.dup_count(table(s, d, "lineitem").select("l_partkey", "l_suppkey"))


@query("dup_sample", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r > 1 ORDER BY event_id LIMIT 20")
def _(s, d):
    return edit.dup_sample(table(s, d, "events").select("event_id", "user_id", "event_type"), ["event_id"])


@query("sort_col", f"SELECT event_id, v FROM {dirty.NULLS} ORDER BY v DESC NULLS LAST, event_id")
def _(s, d):
    return edit.sort_col(dirty.nulls(s, d).select("event_id", "v"), "v", True, ["event_id"])


# --- features


@query("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek, CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter FROM orders")
def _(s, d):
    return features.date_parts(table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("label_encode", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY coalesce(t, 'nan')) - 1 AS INTEGER) AS t_label FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_type END AS t FROM part)")
def _(s, d):
    df = table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_type")).alias("t"))
    return features.label_encode(df, "t").select("p_partkey", "t_label")


@query("label_encode_beside_value", "SELECT event_id, value, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS event_type_label FROM events")
def _(s, d):
    return features.label_encode(table(s, d, "events").select("event_id", "value", "event_type"), "event_type").drop("event_type")


@query("one_hot", "SELECT o_orderkey, o_orderstatus, o_orderstatus = 'F' AS \"o_orderstatus_F\", o_orderstatus = 'O' AS \"o_orderstatus_O\", o_orderstatus = 'P' AS \"o_orderstatus_P\" FROM orders")
def _(s, d):
    return features.one_hot(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("scale_standard", f"SELECT event_id, round((v - (SELECT avg(v) FROM {dirty.NULLS})) / (SELECT stddev_pop(v) FROM {dirty.NULLS}), 6) AS v FROM {dirty.NULLS}")
def _(s, d):
    return features.scale_standard(dirty.nulls(s, d).select("event_id", "v"), ["v"]).withColumn("v", F.round("v", 6))


@query("scale_minmax", f"SELECT event_id, round((v - (SELECT min(v) FROM {dirty.NULLS})) / (SELECT max(v) - min(v) FROM {dirty.NULLS}), 6) AS v FROM {dirty.NULLS}")
def _(s, d):
    return features.scale_minmax(dirty.nulls(s, d).select("event_id", "v"), ["v"]).withColumn("v", F.round("v", 6))


def _describe(c, src):
    q = ", ".join(f"round(quantile_cont({c}, {p}), 3) AS p{int(100 * p)}" for p in (0.25, 0.5, 0.75))
    return f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(min({c}), 3) AS min, {q}, round(max({c}), 3) AS max FROM {src}"


@query("describe", _describe("v", dirty.NULLS) + " UNION ALL " + _describe("value", dirty.NULLS))
def _(s, d):
    return features.describe(dirty.nulls(s, d), ["v", "value"])


_BIN = "CASE WHEN value <= lo + (hi - lo) * 1 / 5 THEN 0 WHEN value <= lo + (hi - lo) * 2 / 5 THEN 1 WHEN value <= lo + (hi - lo) * 3 / 5 THEN 2 WHEN value <= lo + (hi - lo) * 4 / 5 THEN 3 ELSE 4 END"
_ENDS = "(SELECT *, (SELECT min(value) FROM events) AS lo, (SELECT max(value) FROM events) AS hi FROM events)"


@query("bin_equal_width", f"SELECT event_id, {_BIN} AS value_bin FROM {_ENDS}")
def _(s, d):
    return features.bin_equal_width(table(s, d, "events").select("event_id", "value"), "value", 5).select("event_id", "value_bin")


@query("bin_counts", f"SELECT {_BIN} AS bin, count(*) AS n FROM {_ENDS} GROUP BY 1")
def _(s, d):
    return features.bin_counts(table(s, d, "events"), "value", 5)


@query("extract_title", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Mr' WHEN 1 THEN 'Dr' END AS title FROM customer")
def _(s, d):
    k = F.col("c_custkey") % 3
    df = table(s, d, "customer").select("c_custkey", F.concat("c_name", F.when(k == 0, " Mr. X").when(k == 1, " Dr. Y").otherwise(" Z")).alias("n"))
    return features.extract_title(df, "n").select("c_custkey", "title")


@query("rare_group", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_type) < 100 THEN 'Rare' ELSE p_type END AS p_type FROM part")
def _(s, d):
    return features.rare_group(table(s, d, "part").select("p_partkey", "p_type"), "p_type", 100)


@query("split_part", "SELECT p_partkey, trim(string_split(p_brand, '#')[2]) AS p_brand_1, CAST(NULL AS VARCHAR) AS p_brand_4 FROM part")
def _(s, d):
    df = table(s, d, "part").select("p_partkey", "p_brand")
    return features.split_part(features.split_part(df, "p_brand", "#", 1), "p_brand", "#", 4).drop("p_brand")


@query("extract_regex", "SELECT event_id, nullif(regexp_extract(props, '([0-9])[0-9]', 1), '') AS tens FROM events")
def _(s, d):
    return features.extract_regex(table(s, d, "events").select("event_id", "props"), "props", "([0-9])[0-9]", "tens").drop("props")


@query("clean_text", r"SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(props)), '\d+', '', 'g'), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS props FROM events")
def _(s, d):
    return features.clean_text(table(s, d, "events").select("event_id", "props"), "props", digits=True, specials=True)


@query("value_counts", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def _(s, d):
    return features.value_counts(table(s, d, "events"), "event_type")


@query("stream_rowlocal", "SELECT event_id, ts, user_id, upper(event_type) AS event_type, value, props, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month, CAST(isodow(ts) - 1 AS INTEGER) AS ts_dayofweek, true AS streamed FROM events WHERE value > 10")
def _(s, d):
    return rowlocal.run_once(s, d, "events.parquet", table(s, d, "events").schema, scratch(s, "stream"))
