"""Queries over models and their metrics."""

from pyspark.sql import functions as F

from ..operators import dbscan as grid
from ..operators import ml
from .queries_data import scratch
from .registry import query, table

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

#: Restarts of k-means.
SEEDS = tuple(range(42, 52))


def _flags(s, d):
    """lineitem with a label that depends on the numbers."""
    df = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *_FEATURES)
    return df.withColumn("y", F.when(F.col("l_quantity") * (1 + F.col("l_discount")) > 26, 1).otherwise(0))


def _classified(s, d, kind, target="y", **settings):
    data = ml.prepare(_flags(s, d), _FEATURES, target, ("l_orderkey", "l_linenumber"))
    parts = data.withColumn("test", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(5)) == 0)
    return ml.classifier(kind, **settings).fit(parts.where("not test")).transform(parts.where("test"))


@query("split_stratified", "SELECT l_returnflag, count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS test FROM lineitem GROUP BY l_returnflag")
def _(s, d):
    df = table(s, d, "lineitem").select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"))
    return ml.split_stratified(df, "key", "l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if("is_test").alias("test"))


@query("ml_logreg")
def _(s, d):
    return ml.accuracy(_classified(s, d, "logreg", rounds=1000))


@query("ml_rf_clf")
def _(s, d):
    return ml.accuracy(_classified(s, d, "rf"))


@query("ml_svm")
def _(s, d):
    return ml.accuracy(_classified(s, d, "svm"))


@query("ml_gbt")
def _(s, d):
    return ml.accuracy(_classified(s, d, "gbt"))


_D = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]) ^ 2))"


@query("ml_knn", f"SELECT vec_id, neighbour, CAST(rank AS INTEGER) AS rank, label FROM (SELECT a.vec_id, b.vec_id AS neighbour, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_D}, 9), b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5")
def _(s, d):
    e = table(s, d, "embeddings")
    return ml.knn(e.where("vec_id % 100 = 0"), e, "embedding", "vec_id", "label").select("vec_id", "neighbour", "rank", "label")


@query("ml_linreg", "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem")
def _(s, d):
    model = ml.regressor("linreg").fit(ml.prepare(table(s, d, "lineitem"), ["l_quantity"], "l_extendedprice"))
    fitted = s.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")
    return fitted.select(F.round("slope", 3).alias("slope"), F.round("intercept", 1).alias("intercept"))


@query("ml_rf_reg")
def _(s, d):
    data = ml.prepare(_flags(s, d), ["l_quantity", "l_discount"], "l_extendedprice", ("l_orderkey",))
    return ml.regression_metrics(ml.regressor("rf").fit(data).transform(data))


@query("ml_kmeans")
def _(s, d):
    data = ml.prepare(table(s, d, "part"), ["p_size", "p_retailprice"], None, ("p_partkey",))
    return ml.kmeans(data, 4, SEEDS, scale=True)[1].select("p_partkey", "cluster")


@query("cluster_sizes")
def _(s, d):
    data = ml.prepare(table(s, d, "part"), ["p_size", "p_retailprice"], None, ("p_partkey",))
    return ml.cluster_sizes(ml.kmeans(data, 4, SEEDS, scale=True)[1])


@query("cluster_label")
def _(s, d):
    df = table(s, d, "part").withColumn("p_size", F.when(F.col("p_partkey") % 10 != 0, F.col("p_size")))
    data = ml.prepare(df, ["p_size", "p_retailprice"], None, ("p_partkey",))
    return ml.cluster_label(df, "p_partkey", ml.kmeans(data, 3, SEEDS, scale=True)[1]).select("p_partkey", "p_size", "cluster")


_DBSCAN = """
WITH RECURSIVE p AS (SELECT c_custkey AS k, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer),
near AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1),
core AS (SELECT a AS k FROM near GROUP BY a HAVING count(*) >= 4),
link AS (SELECT a, b FROM near WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core)),
reach AS (SELECT k, k AS r FROM core UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.k),
lab AS (SELECT k, min(r) AS label FROM reach GROUP BY k),
num AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM (SELECT DISTINCT label FROM lab)),
every AS (SELECT k, label FROM lab UNION ALL SELECT a, min(label) FROM near JOIN lab ON near.b = lab.k WHERE a NOT IN (SELECT k FROM core) GROUP BY a)
SELECT c_custkey, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster FROM customer LEFT JOIN every ON c_custkey = k LEFT JOIN num USING (label)
"""


@query("dbscan", _DBSCAN)
def _(s, d):
    df = table(s, d, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return grid.dbscan(df, "c_custkey", ["x", "y"], 1.0, 4)


# Metrics are held to SQL on a fixed rule instead of a model: quality is predicted by n_chars > 500.
_RULE = "(SELECT quality AS label, CAST(n_chars > 500 AS INTEGER) AS prediction FROM documents JOIN labels USING (doc_id))"


def _rule(s, d):
    pred = (F.col("n_chars") > 500).cast("int").alias("prediction")
    return table(s, d, "documents").select("doc_id", pred).join(table(s, d, "labels"), "doc_id").select(F.col("quality").alias("label"), "prediction")


@query("metric_accuracy", f"SELECT round(avg(CAST(label = prediction AS INTEGER)), 6) AS accuracy FROM {_RULE}")
def _(s, d):
    return ml.accuracy(_rule(s, d))


@query("confusion", f"SELECT label, prediction, count(*) AS n FROM {_RULE} GROUP BY label, prediction")
def _(s, d):
    return ml.confusion(_rule(s, d))


_REPORT = f"""WITH r AS (SELECT * FROM {_RULE}), k AS (SELECT DISTINCT label AS c FROM r UNION SELECT DISTINCT prediction FROM r),
m AS (SELECT c, coalesce(count(*) FILTER (label = c AND prediction = c) / nullif(count(*) FILTER (prediction = c), 0), 0.0) AS p, coalesce(count(*) FILTER (label = c AND prediction = c) / nullif(count(*) FILTER (label = c), 0), 0.0) AS q, count(*) FILTER (label = c) AS support FROM r, k GROUP BY c),
f AS (SELECT *, coalesce(2 * p * q / nullif(p + q, 0), 0.0) AS f1 FROM m)
SELECT CAST(c AS VARCHAR) AS class, round(p, 6) AS precision, round(q, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(q), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted', round(sum(p * support) / sum(support), 6), round(sum(q * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f"""


@query("clf_report", _REPORT)
def _(s, d):
    return ml.classification_report(_rule(s, d))


@query("metric_regression", "SELECT round(1 - sum((y - p) ^ 2) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ^ 2)), 6) AS rmse FROM (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)")
def _(s, d):
    return ml.regression_metrics(table(s, d, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction")))


# Least squares on two features, in closed form.
_PLANE = """(SELECT (cxy * vd - cdy * cxd) / (vx * vd - cxd * cxd) AS b, (cdy * vx - cxy * cxd) / (vx * vd - cxd * cxd) AS c, my, mx, md FROM (SELECT covar_pop(l_quantity, l_extendedprice) AS cxy,
covar_pop(l_discount, l_extendedprice) AS cdy, covar_pop(l_quantity, l_discount) AS cxd, var_pop(l_quantity) AS vx, var_pop(l_discount) AS vd, avg(l_extendedprice) AS my, avg(l_quantity) AS mx, avg(l_discount) AS md FROM lineitem))"""


@query("actual_vs_pred", f"SELECT l_orderkey, l_extendedprice AS actual, round(my + b * (l_quantity - mx) + c * (l_discount - md), 2) AS predicted FROM lineitem, {_PLANE}")
def _(s, d):
    data = ml.prepare(_flags(s, d), ["l_quantity", "l_discount"], "l_extendedprice", ("l_orderkey",))
    out = ml.actual_vs_pred(ml.regressor("linreg").fit(data).transform(data), "l_orderkey")
    return out.withColumn("predicted", F.round("predicted", 2))


@query("importances")
def _(s, d):
    return ml.importances(ml.classifier("rf").fit(ml.prepare(_flags(s, d), _FEATURES, "y")), _FEATURES)


@query("model_save")
def _(s, d):
    from pyspark.ml.regression import LinearRegressionModel

    from ..sources.sinks import save_model

    data = ml.prepare(table(s, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", ("l_orderkey",))
    path = scratch(s, "model")
    save_model(ml.regressor("linreg").fit(data), path)
    return ml.regression_metrics(LinearRegressionModel.load(path).transform(data))
