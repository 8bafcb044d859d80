"""Feature engineering."""

from pyspark.sql import functions as F

from ..functions.expr import col_of, per_column, strip
from .ranks import numbered, with_quantiles


def date_parts(df, column, parts=("year", "month", "day", "dayofweek", "quarter")):
    """{column}_{part}; days of the week count from Monday = 0."""
    c = col_of(column)
    make = {"year": F.year, "month": F.month, "day": F.day, "dayofweek": F.weekday, "quarter": F.quarter}
    return df.withColumns({f"{column}_{p}": make[p](c) for p in parts})


def label_table(df, column, null_class=None):
    """(label, value): distinct values as text in order, labels from 0. The table is as small as the column's vocabulary."""
    v = col_of(column).cast("string")
    v = F.coalesce(v, F.lit(null_class)) if null_class is not None else v
    values = df.select(v.alias("value")).where("value is not null").distinct()
    return numbered(values, "value", "label").select("label", "value")


def label_encode(df, column, out=None, null_class="nan"):
    """Labels 0 .. k-1 of the sorted distinct texts; null is the class named ``nan``. A column that ``out`` names is replaced."""
    out = out or f"{column}_label"
    table = label_table(df, column, null_class).select(F.col("label").alias("__label"), F.col("value").alias("__value"))
    v = F.coalesce(col_of(column).cast("string"), F.lit(null_class))
    found = df.withColumn("__v", v).join(table, F.col("__v") == F.col("__value"), "left")
    return found.select(*[col_of(c) for c in df.columns if c.lower() != out.lower()], F.col("__label").alias(out))


def one_hot(df, column, most=1000):
    """{column}_{value} booleans, one a distinct non-null value in order; null is false in all. More than ``most`` values
    are refused: they would be columns."""
    values = [r[0] for r in df.select(col_of(column)).where(col_of(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has over {most} values")
    return df.withColumns({f"{column}_{v}": F.coalesce(col_of(column) == F.lit(v), F.lit(False)) for v in sorted(values)})


def scale_standard(df, columns):
    """(x - mean) / population deviation; a deviation of zero divides by one; nulls stay."""
    row = df.agg(*[f(col_of(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({c: (col_of(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def scale_minmax(df, columns):
    """(x - min) / (max - min); a constant column becomes 0."""
    row = df.agg(*[f(col_of(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("a", F.min), ("b", F.max))]).first()
    return df.withColumns({c: (col_of(c) - F.lit(row[f"a{i}"])) / F.lit(((row[f"b{i}"] or 0.0) - (row[f"a{i}"] or 0.0)) or 1.0) for i, c in enumerate(columns)})


def describe(df, columns):
    """(column, n, mean, std, min, p25, p50, p75, max), three decimals."""
    r = lambda f: lambda c: F.round(f(c.cast("double")), 3)
    out = per_column(df, columns, {"n": F.count, "mean": r(F.avg), "std": r(F.stddev_samp), "min": r(F.min), "max": r(F.max)})
    out = with_quantiles(out, df, columns, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, 3)
    return out.select("column", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def bin_edges(df, column, bins):
    """Right-closed equal-width edges; the lowest is lowered by 0.1 % of the range, a constant column's by 0.1 % of it."""
    c = col_of(column).cast("double")
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    if lo is None:
        return None
    if lo == hi:
        pad = 0.001 * abs(lo) if lo else 0.001
        return [lo - pad + 2 * pad * i / bins for i in range(bins + 1)]
    edges = [lo + (hi - lo) * i / bins for i in range(bins)]
    return [lo - (hi - lo) * 0.001, *edges[1:], hi]  # lo + (hi - lo) may be rounded below hi


def bin_equal_width(df, column, bins, out=None, labels=None):
    """The 0-based bin of each value (or its label, where exactly ``bins`` are given); null stays null. The first and the last
    bin have no outer edge, so rounding leaves no value out."""
    out = out or f"{column}_bin"
    edges = bin_edges(df, column, bins)
    named = labels if labels and len(labels) == bins else None
    kind = "string" if named else "int"
    if edges is None:
        return df.withColumn(out, F.lit(None).cast(kind))
    c = col_of(column).cast("double")
    made = F.lit(named[-1] if named else bins - 1)
    for i in reversed(range(bins - 1)):
        made = F.when(c <= edges[i + 1], F.lit(named[i] if named else i)).otherwise(made)
    return df.withColumn(out, F.when(c.isNotNull(), made))


def bin_counts(df, column, bins):
    return bin_equal_width(df, column, bins, "bin").where("bin is not null").groupBy("bin").agg(F.count("*").alias("n")).orderBy("bin")


def extract_title(df, column, out="title"):
    return df.withColumn(out, F.nullif(F.regexp_extract(col_of(column), r" ([A-Za-z]+)\.", 1), F.lit("")))


def rare_group(df, column, threshold, out=None):
    """Values seen fewer than ``threshold`` times as ``Rare``. Counts are grouped, not windowed, so a frequent value is no hot spot."""
    counts = df.where(col_of(column).isNotNull()).groupBy(col_of(column).alias("__v")).agg(F.count("*").alias("__n"))
    often = counts.where(F.col("__n") >= threshold).select("__v")
    joined = df.join(often, col_of(column) == F.col("__v"), "left")
    v = F.when(F.col("__v").isNotNull() | col_of(column).isNull(), col_of(column).cast("string")).otherwise("Rare")
    return joined.withColumn(out or column, v).drop("__v")


def split_part(df, column, sep, part, out=None):
    """A 0-based part, trimmed; null where there is none. One character is literal, more are a regex."""
    pattern = f"\\Q{sep}\\E" if len(sep) == 1 else sep
    return df.withColumn(out or f"{column}_{part}", strip(F.get(F.split(col_of(column), pattern, -1), F.lit(part))))


def extract_regex(df, column, pattern, out):
    return df.withColumn(out, F.when(col_of(column).rlike(pattern), F.regexp_extract(col_of(column), pattern, 1)))


def clean_text(df, column, lowercase=True, trim=True, digits=False, specials=False, spaces=True, out=None):
    """In this order: lower case, strip, without digits, without specials, white space collapsed."""
    c = col_of(column)
    c = F.lower(c) if lowercase else c
    c = strip(c) if trim else c
    c = F.regexp_replace(c, r"(?U)\d+", "") if digits else c
    c = F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s]", "") if specials else c
    c = strip(F.regexp_replace(c, r"(?U)\s+", " ")) if spaces else c
    return df.withColumn(out or column, c)


def value_counts(df, column):
    return df.where(col_of(column).isNotNull()).groupBy(col_of(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
