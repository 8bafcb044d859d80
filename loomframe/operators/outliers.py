"""Outliers by quartiles or z-scores."""

from pyspark.sql import functions as F

from ..functions.expr import col_of, numeric_columns, one_row
from .ranks import quantiles


def bounds(df, column, method="iqr", threshold=None, approximate=False):
    """(low, high) or None. iqr: 1.5 (or ``threshold``) ranges beyond the quartiles; zscore: 3 (or so many) sample deviations."""
    c = col_of(column).cast("double")
    if method == "iqr":
        got = one_row(df, q=F.percentile_approx(c, [0.25, 0.75], 10_000))["q"] if approximate else quantiles(df, [column], [0.25, 0.75])[column]
        if got is None or got[0] is None:
            return None
        reach = (threshold or 1.5) * (got[1] - got[0])
        return got[0] - reach, got[1] + reach
    got = one_row(df, m=F.avg(c), s=F.stddev_samp(c))
    if not got["s"]:
        return None
    return got["m"] - (threshold or 3.0) * got["s"], got["m"] + (threshold or 3.0) * got["s"]


def flag(df, column, method="iqr", threshold=None):
    """The outlier test as a Column; null is no outlier."""
    b = bounds(df, column, method, threshold)
    if b is None:
        return F.lit(False)
    c = col_of(column)
    return F.coalesce((c < b[0]) | (c > b[1]), F.lit(False))


def outlier_flag(df, column, method="iqr", threshold=None, out="outlier"):
    return df.withColumn(out, flag(df, column, method, threshold))


def outlier_remove(df, column, method="iqr", threshold=None):
    return df.where(~flag(df, column, method, threshold))


def outlier_cap(df, column, method="iqr", threshold=None):
    """Values beyond the bounds at the bounds; the column becomes double; null stays."""
    b = bounds(df, column, method, threshold)
    c = col_of(column).cast("double")
    return df if b is None else df.withColumn(column, F.when(c < b[0], b[0]).when(c > b[1], b[1]).otherwise(c))


def outlier_median(df, column, method="iqr", threshold=None):
    mid = quantiles(df, [column], [0.5])[column][0]
    return df.withColumn(column, F.when(flag(df, column, method, threshold), F.lit(mid)).otherwise(col_of(column).cast("double")))


def outlier_summary(df, columns=None, least=8):
    """(column, outliers, percent) of numeric columns with at least ``least`` values and a quartile range, most first: two
    wide aggregations, quartiles and then counts."""
    cols = columns or numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, outliers long, percent double")
    row = df.agg(*[F.count(col_of(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    enough = [c for i, c in enumerate(cols) if row[i] >= least]
    fit = {c: q for c, q in quantiles(df, enough, [0.25, 0.75]).items() if q[0] != q[1]}
    if not fit:
        return df.sparkSession.createDataFrame([], "column string, outliers long, percent double")
    wide = []
    for c, (a, b) in fit.items():
        x, reach = col_of(c), 1.5 * (b - a)
        wide.append(F.struct(F.lit(c).alias("column"), F.count_if((x < a - reach) | (x > b + reach)).alias("outliers"), F.count(x).alias("n")))
    out = df.agg(F.array(*wide).alias("r")).select(F.inline("r")).where("outliers > 0")
    return out.select("column", "outliers", F.bround(100 * F.col("outliers") / F.col("n"), 2).alias("percent")).orderBy(F.desc("outliers"), "column")


def outlier_list(df, column, order_by, method="iqr", threshold=None, n=50):
    """The first ``n`` outliers in the order given, each with the count and percent of all."""
    b = flag(df, column, method, threshold)
    total = df.agg(F.count_if(b).alias("outliers"), F.bround(F.coalesce(F.try_divide(100.0 * F.count_if(b), F.count("*")), F.lit(0.0)), 2).alias("percent"))
    return df.where(b).orderBy(*[col_of(c) for c in order_by]).limit(n).crossJoin(total)


