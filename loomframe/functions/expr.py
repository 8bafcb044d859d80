"""Column expressions that the operators share. Spark runs with ANSI on: everything that touches user data must not raise."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that reads as a number. Spark's own cast would also take '1d' and '1f'.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def col_of(name):
    """A column by name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(field):
    return isinstance(field.dataType, T.NumericType)


def is_text(field):
    return isinstance(field.dataType, T.StringType)


def is_time(field):
    return isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def names(df, test):
    return [f.name for f in df.schema.fields if test(f)]


def numeric_columns(df):
    return names(df, is_numeric)


def text_columns(df):
    return names(df, is_text)


def time_columns(df):
    return names(df, is_time)


def strip(c):
    """Without white space at either end (all of Unicode's, not only blanks)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def reads_as_number(c):
    return strip(c.cast("string")).rlike(NUMBER)


def number(c):
    """The value of a text that reads as a number, else null; numbers pass through as double, NaN becomes null."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def denan(df):
    """Float NaN as null, since Spark's avg, max and percentile would let it through."""
    at = {f.name: F.nanvl(col_of(f.name), F.lit(None).cast(f.dataType)) for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(at) if at else df


def per_column(df, cols, stats, name="column"):
    """One row a column from one aggregation over all of them: ``stats`` maps an output name to f(column) -> aggregate."""
    if not cols:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(name, T.StringType())] + [T.StructField(k, T.DoubleType()) for k in stats]))
    rows = [F.struct(F.lit(c).alias(name), *[f(col_of(c)).alias(k) for k, f in stats.items()]) for c in cols]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def one_row(df, **aggs):
    """A dict of a few aggregates, from one job; the statistics that data-driven operators turn into literals."""
    row = df.agg(*[v.alias(k) for k, v in aggs.items()]).first()
    return row.asDict() if row else {}


def literal_of(text):
    """A typed literal from user text: with a point a float, else an int, else the text itself."""
    try:
        return float(text) if "." in text else int(text)
    except (TypeError, ValueError):
        return text


def round_even(c, digits):
    return F.bround(c, digits)


#: strptime directives and Spark's letters for them.
STRPTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%f": "SSSSSS", "%z": "xx"}


def spark_format(strptime):
    """``%d/%m/%Y`` as ``dd/MM/yyyy``; other letters are quoted."""
    out, i = "", 0
    while i < len(strptime):
        two = strptime[i : i + 2]
        if two in STRPTIME:
            out, i = out + STRPTIME[two], i + 2
        else:
            c = strptime[i]
            out, i = out + (f"'{c}'" if c.isalpha() else c), i + 1
    return out
