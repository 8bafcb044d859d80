"""Counting and filling nulls."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import col_of, is_numeric, number, numeric_columns, per_column
from .ranks import modes, quantiles


def null_summary(df):
    """(column, missing, percent), columns with nulls only, most missing first."""
    out = per_column(df, df.columns, {"missing": lambda c: F.count_if(c.isNull()), "rows": lambda c: F.count("*")})
    out = out.where("missing > 0").withColumn("percent", F.bround(100 * F.col("missing") / F.col("rows"), 1))
    return out.select("column", "missing", "percent").orderBy(F.desc("missing"), "column")


def severity(percent):
    return F.when(percent > 30, "High").when(percent > 10, "Medium").otherwise("Low")


def null_severity(df):
    return null_summary(df).withColumn("severity", severity(F.col("percent")))


def _fits(value, field):
    if isinstance(value, bool):
        return isinstance(field.dataType, T.BooleanType)
    if isinstance(value, int):
        return is_numeric(field)
    if isinstance(value, float):
        return isinstance(field.dataType, (T.FloatType, T.DoubleType, T.DecimalType))
    return isinstance(field.dataType, T.StringType)


def fill_const(df, value, columns=None):
    """Nulls as ``value``. A whole-number column takes a float as double; where the value fits not at all, the column
    becomes text."""
    out = {}
    for f in df.schema.fields:
        if columns is None or f.name in columns:
            c = col_of(f.name)
            if _fits(value, f):
                out[f.name] = F.coalesce(c, F.lit(value).cast(f.dataType))
            elif is_numeric(f) and isinstance(value, float):
                out[f.name] = F.coalesce(c.cast("double"), F.lit(value))
            else:
                out[f.name] = F.coalesce(c.cast("string"), F.lit(str(value)))
    return df.withColumns(out)


def fill_custom(df, columns, value, as_number=False):
    """The same for named columns; ``as_number`` reads the columns as numbers first."""
    if as_number:
        df = df.withColumns({c: number(col_of(c)) for c in columns})
        value = float(value)
    return fill_const(df, value, columns)


def _fill_stat(df, columns, stat):
    cols = columns or numeric_columns(df)
    if not cols:
        return df
    row = df.agg(*[stat(col_of(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return _fill_with(df, dict(zip(cols, row)))


def _fill_with(df, values):
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(col_of(c).cast("double") if isinstance(v, float) and kinds[c] != "float" else col_of(c), F.lit(v)) for c, v in values.items() if v is not None})


def fill_mean(df, columns=None):
    return _fill_stat(df, columns, F.avg)


def fill_median(df, columns=None, approximate=False):
    """The interpolated median, exact in bounded memory; ``approximate`` takes one pass."""
    if approximate:
        return _fill_stat(df, columns, lambda c: F.percentile_approx(c.cast("double"), 0.5, 10_000))
    found = quantiles(df, columns or numeric_columns(df), [0.5])
    return _fill_with(df, {c: v[0] for c, v in found.items()})


def fill_mode(df, columns=None):
    """The most frequent value, the smallest on a tie."""
    return _fill_with(df, modes(df, list(columns or df.columns)))


def drop_any_null(df):
    return df.dropna("any")


def _fill_ordered(df, column, order_by, partition_by, back):
    span = (0, Window.unboundedFollowing) if back else (Window.unboundedPreceding, 0)
    w = Window.partitionBy(*[col_of(p) for p in partition_by]).orderBy(col_of(order_by)).rowsBetween(*span)
    pick = F.first if back else F.last
    return df.withColumn(column, pick(col_of(column), ignorenulls=True).over(w))


def _fill_global(df, column, order_by, back, rows):
    """Without a key a window would move all rows to one task. Rows are cut into 32 order ranges or more, of about ``rows``, by literal
    quantile bounds, every range passes on its last (first) value, and a window runs inside each range. A value of the
    order column so frequent that it spans several ranges is dealt to as many by a hash of the row, and so are rows
    without an order value, which come first: rows tied in the order may come in any order."""
    order = col_of(order_by)
    as_long = F.unix_micros(order.cast("timestamp")) if dict(df.dtypes)[order_by] in ("timestamp", "timestamp_ntz", "date") else order.cast("double")
    parts = max(32, min(1024, df.count() // rows + 1))
    cuts = df.agg(F.percentile_approx(as_long, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0] or []
    times = {c: cuts.count(c) for c in cuts}
    cuts, wide = sorted(times), max([parts, *times.values()])
    tie = F.xxhash64(*[col_of(c) for c, kind in df.dtypes if "map<" not in kind])
    deal = F.pmod(tie, F.lit(wide))

    def place(lo, hi):
        """The range of a value between the bounds, by halving."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(as_long <= cuts[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

    often = [c for c, n in times.items() if n > 1]
    within = F.when(as_long.isin(often), 1 + deal).otherwise(0) if often else F.lit(0)
    pid = F.when(as_long.isNull(), deal - wide).otherwise(place(0, len(cuts)) * (wide + 1) + within)
    tagged = df.withColumn("__pid", pid.cast("long"))
    present = F.when(col_of(column).isNotNull(), F.struct(F.coalesce(as_long, F.lit(0)), tie))
    carry = tagged.groupBy("__pid").agg((F.min_by if back else F.max_by)(col_of(column), present).alias("v"))  # one row a range
    w = Window.orderBy("__pid").rowsBetween(*((1, Window.unboundedFollowing) if back else (Window.unboundedPreceding, -1)))
    carry = carry.select("__pid", (F.first if back else F.last)("v", ignorenulls=True).over(w).alias("__carry"))
    span = (0, Window.unboundedFollowing) if back else (Window.unboundedPreceding, 0)
    inside = Window.partitionBy("__pid").orderBy(order, tie).rowsBetween(*span)
    filled = tagged.withColumn(column, (F.first if back else F.last)(col_of(column), ignorenulls=True).over(inside))
    out = filled.join(F.broadcast(carry), "__pid").withColumn(column, F.coalesce(col_of(column), F.col("__carry")))
    return out.select(*[col_of(c) for c in df.columns])


def fill_forward(df, column, order_by, partition_by=(), rows=250_000):
    """The last value before in ``order_by`` order, per key where one is given, else over the whole table."""
    return _fill_ordered(df, column, order_by, partition_by, False) if partition_by else _fill_global(df, column, order_by, False, rows)


def fill_backward(df, column, order_by, partition_by=(), rows=250_000):
    return _fill_ordered(df, column, order_by, partition_by, True) if partition_by else _fill_global(df, column, order_by, True, rows)
