"""The test tables hold no nulls, so queries that are about dirt derive it from keys; Spark and SQL sides by side."""

from pyspark.sql import functions as F

from .registry import table

#: events with a nullable number v
NULLS = "(SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)"
#: lineitem with a padded text f that holds fake nulls
PADDED = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN ' N/A ' WHEN l_orderkey % 17 = 0 THEN '-' ELSE concat('  ', l_returnflag, chr(9)) END AS f FROM lineitem)"
#: orders with a mostly numeric text t
MIXED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'bad' WHEN o_orderkey % 23 = 0 THEN '12d' WHEN o_orderkey % 29 = 0 THEN NULL ELSE concat(' ', CAST(o_custkey AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN '.75' ELSE '' END) END AS t FROM orders)"
#: events with a yes/no text b
YESNO = "(SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'maybe' WHEN event_id % 2 = 0 THEN 'Y' ELSE 'no' END AS b FROM events)"
#: orders with day-first date texts d and a few failures
DATES = "(SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS d FROM orders)"
#: nation with empty rows and an empty column
HOLES = "(SELECT CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS a, CAST(NULL AS VARCHAR) AS e FROM nation)"
#: the number in a text, or null
NUM = "CASE WHEN regexp_matches(trim({0}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(trim({0}) AS DOUBLE) END"


def nulls(s, d):
    return table(s, d, "events").withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))


def padded(s, d):
    f = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 13 == 0, " N/A ").when(F.col("l_orderkey") % 17 == 0, "-").otherwise(F.concat(F.lit("  "), "l_returnflag", F.lit("\t")))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f.alias("f"))


def mixed(s, d):
    k = F.col("o_orderkey")
    t = F.when(k % 19 == 0, "bad").when(k % 23 == 0, "12d").when(k % 29 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.when(k % 2 == 0, ".75").otherwise("")))
    return table(s, d, "orders").select("o_orderkey", t.alias("t"))


def yesno(s, d):
    k = F.col("event_id")
    return table(s, d, "events").select("event_id", F.when(k % 10 == 0, "maybe").when(k % 2 == 0, "Y").otherwise("no").alias("b"))


def dates(s, d):
    t = F.when(F.col("o_orderkey") % 31 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(s, d, "orders").select("o_orderkey", t.alias("d"))


def holes(s, d):
    return table(s, d, "nation").select(F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("a"), F.lit(None).cast("string").alias("e"))
