"""KPIs, grouped sums and the data behind charts."""

from pyspark.sql import functions as F

from ..functions.expr import col_of, one_row, per_column
from .ranks import grouped_quantiles, quantiles, with_quantiles

AGGREGATES = {"Sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "Mean": F.avg, "Max": F.max, "Min": F.min, "Count": lambda c: F.count(c).cast("double")}


def kpi_aggregate(df, column, how="Sum"):
    """Over non-null values; an unknown name means Sum, a missing column 0."""
    return AGGREGATES.get(how, AGGREGATES["Sum"])(col_of(column).cast("double")) if column in df.columns else F.lit(0.0)


def kpi_value(df, column, how="Sum"):
    return df.agg(F.round(kpi_aggregate(df, column, how), 2).alias("value"))


def achievement(current, target):
    """Percent of target, one decimal; a target of 0 gives 0."""
    return F.when(target == 0, 0.0).otherwise(F.bround(F.try_divide(100.0 * current, target), 1))


def kpi_report(df, targets):
    """(kpi, current, annual, quarterly, achievement, status). ``targets``: {column: {annual, quarterly, agg}}; the
    quarterly target is a quarter of the annual one by default."""
    rows = []
    for c, t in targets.items():
        annual = float(t["annual"])
        rows.append(F.struct(F.lit(c).alias("kpi"), F.round(kpi_aggregate(df, c, t.get("agg", "Sum")), 2).alias("current"), F.lit(annual).alias("annual"), F.lit(float(t.get("quarterly") or annual / 4)).alias("quarterly")))
    out = df.agg(F.array(*rows).alias("r")).select(F.inline("r")).withColumn("achievement", achievement(F.col("current"), F.col("annual")))
    return out.withColumn("status", F.when(F.col("achievement") >= 100, "Met").when(F.col("achievement") >= 70, "On Track").otherwise("Below"))


def kpi_trend(df, date, value):
    return df.select(col_of(date).alias("date"), col_of(value).alias("value")).dropna().orderBy("date", "value")


def top_n_sum(df, key, value, n=10):
    """(key, total): largest sums; null keys are left out; ties by key."""
    out = df.where(col_of(key).isNotNull()).groupBy(col_of(key).alias("key")).agg(F.round(F.sum(col_of(value)), 2).alias("total"))
    return out.orderBy(F.desc("total"), "key").limit(n)


def pie_top_n(df, key, value, n=10):
    """top_n_sum with each one's share of what is shown."""
    top = top_n_sum(df, key, value, n)
    return top.crossJoin(top.agg(F.sum("total").alias("__t"))).select("key", "total", F.round(F.try_divide(F.col("total"), F.col("__t")), 6).alias("share"))


def histogram(df, column, bins=20):
    """(bin, low, high, n) of equal-width bins, the last closed; a constant column has one bin."""
    c = col_of(column).cast("double")
    got = one_row(df, lo=F.min(c), hi=F.max(c))
    lo, hi = got["lo"], got["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((c - lo) / width), F.lit(bins - 1)).cast("int")
    out = df.where(c.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return out.select("bin", F.round(lo + F.col("bin") * width, 6).alias("low"), F.round(lo + (F.col("bin") + 1) * width, 6).alias("high"), "n").orderBy("bin")


def line_series(df, x, y):
    return df.select(col_of(x).alias("x"), col_of(y).alias("y")).orderBy("x", "y")


def scatter_xy(df, x, y, colour=None, most=None, seed=42):
    """(x, y, colour); above ``most`` rows a seeded sample of about so many, as a chart can't show more."""
    out = df.select(col_of(x).alias("x"), col_of(y).alias("y"), (col_of(colour) if colour else F.lit(None).cast("string")).alias("colour"))
    if most:
        n = df.count()
        out = out.sample(min(1.0, most / n), seed) if n > most else out
    return out


def box_stats(df, column, group=None):
    """(grp, n, min, q1, median, q3, max)."""
    c = col_of(column).cast("double")
    names, probs = ("q1", "median", "q3"), [0.25, 0.5, 0.75]
    stats = [F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max")]
    if group:
        base, q = df.groupBy(col_of(group).alias("grp")).agg(*stats), grouped_quantiles(df, column, group, probs).select(F.col("grp").alias("__g"), "q")
        out = base.join(q, F.col("grp").eqNullSafe(F.col("__g")), "left").withColumns({n: F.round(F.get("q", F.lit(i)), 6) for i, n in enumerate(names)})
    else:
        found = quantiles(df, [column], probs)[column]
        out = df.groupBy(F.lit("all").alias("grp")).agg(*stats).withColumns({n: F.round(F.lit(v).cast("double"), 6) for n, v in zip(names, found)})
    return out.select("grp", "n", "min", *names, "max")


def correlation(df, columns):
    """(a, b, r) for every pair a < b, over rows where both are present, from one aggregation; a constant gives null. It is known
    by its least and largest value, as merged partitions give it a deviation by rounding."""
    rows = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            x, y = col_of(a).cast("double"), col_of(b).cast("double")
            both = x.isNotNull() & y.isNotNull()
            x, y = F.when(both, x), F.when(both, y)
            r = F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
            rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(r, 6).alias("r")))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def distribution(df, columns):
    return with_quantiles(per_column(df, columns, {"n": F.count}), df, columns, {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}, 6)
