"""Type conversion and text tools, one column at a time."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import col_of, number, per_column, spark_format, strip
from .clean import as_date

#: Texts that count as true, with case.
TRUE_WORDS = ["true", "1", "yes", "y", "نعم", "صح", "True", "Yes"]


def type_table(df, approximate=False):
    """(column, type, non_null, missing, distinct_values): distinct counts take one two-level grouping over (column, value)."""
    base = per_column(df, df.columns, {"non_null": F.count, "missing": lambda c: F.count_if(c.isNull()), **({"distinct_values": F.approx_count_distinct} if approximate else {})})
    kinds = F.create_map(*[F.lit(x) for kv in df.dtypes for x in kv])
    base = base.withColumn("type", kinds[F.col("column")])
    if approximate:
        return base
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), col_of(c).cast("string").alias("v")) for c in df.columns])))
    distinct = pairs.where("v is not null").groupBy("column", "v").agg(F.lit(1)).groupBy("column").agg(F.count("*").alias("distinct_values"))
    return base.join(F.broadcast(distinct), "column", "left").fillna({"distinct_values": 0}).select("column", "type", "non_null", "missing", "distinct_values")


def cast_int(df, column, bits=64):
    """Whole numbers by truncation; what does not parse or fit becomes 0."""
    kind = {64: "bigint", 32: "int", 8: "tinyint"}[bits]
    return df.withColumn(column, F.coalesce(number(col_of(column)).try_cast(kind), F.lit(0).cast(kind)))


def cast_float(df, column, bits=64):
    return df.withColumn(column, number(col_of(column)).try_cast({64: "double", 32: "float"}[bits]))


def coerce_numeric(df, columns):
    return df.withColumns({c: number(col_of(c)) for c in columns})


def cast_text(df, column):
    return df.withColumn(column, col_of(column).cast("string"))


def category_dict(df, column):
    """(code, value): distinct values in order, codes from 0."""
    from .features import label_table

    return label_table(df, column).withColumnsRenamed({"label": "code"})


def timestamp_of(c, fmt=None):
    return F.try_to_timestamp(c.cast("string"), F.lit(spark_format(fmt))) if fmt else as_date(c.cast("string"))


def cast_datetime(df, column, fmt=None):
    """Timestamps by a strptime format, or by the day-first list of formats; failures become null."""
    return df.withColumn(column, timestamp_of(col_of(column), fmt).cast("timestamp_ntz"))


def cast_date(df, column, fmt=None):
    return df.withColumn(column, timestamp_of(col_of(column), fmt).cast("date"))


def cast_time(df, column, fmt=None):
    """Time of day as HH:mm:ss text."""
    c = col_of(column)
    ts = c if isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType)) else timestamp_of(c, fmt)
    return df.withColumn(column, F.date_format(ts, "HH:mm:ss"))


def cast_bool(df, column):
    return df.withColumn(column, F.coalesce(strip(col_of(column).cast("string")).isin(TRUE_WORDS), F.lit(False)))


def extract_number(df, column):
    return df.withColumn(column, F.regexp_substr(col_of(column).cast("string"), F.lit(r"[0-9.]+")).try_cast("double"))


def extract_date_text(df, column):
    return df.withColumn(column, F.regexp_substr(col_of(column).cast("string"), F.lit(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}")))


def text_case(df, column, case):
    return df.withColumn(column, {"upper": F.upper, "lower": F.lower}[case](col_of(column).cast("string")))


def text_title(df, column):
    """A capital after every character that is no letter, the rest small."""
    parts = F.regexp_extract_all(F.lower(col_of(column).cast("string")), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return df.withColumn(column, F.array_join(F.transform(parts, F.initcap), ""))


def keep_arabic(df, column):
    return df.withColumn(column, strip(F.regexp_replace(col_of(column).cast("string"), r"[^\x{0600}-\x{06FF}\s]", "")))


def remove_special(df, column):
    return df.withColumn(column, strip(F.regexp_replace(col_of(column).cast("string"), r"[^a-zA-Z0-9\x{0600}-\x{06FF}\s]", "")))
