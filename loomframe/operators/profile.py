"""Profiles and quality."""

from pyspark.sql import functions as F

from ..functions.expr import NUMBER, col_of, is_numeric, numeric_columns, per_column, strip, text_columns, time_columns
from .edit import dup_count
from .nulls import null_summary
from .ranks import modes


def overview(df):
    """One row: rows, columns, null cells and their share, duplicates, numeric and text columns."""
    cells = F.lit(0)
    for c in df.columns:
        cells = cells + F.when(col_of(c).isNull(), 1).otherwise(0)
    base = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(cells), F.lit(0)).cast("long").alias("null_cells"))
    out = base.crossJoin(dup_count(df).select("duplicates"))  # one row each
    share = F.try_divide(100.0 * F.col("null_cells"), F.col("rows") * len(df.columns))
    return out.select("rows", F.lit(len(df.columns)).alias("columns"), "null_cells", F.bround(F.coalesce(share, F.lit(0.0)), 2).alias("null_percent"), "duplicates", F.lit(len(numeric_columns(df))).alias("numeric_columns"), F.lit(len(text_columns(df))).alias("text_columns"))


def column_profile(df):
    """(column, type, non_null, missing, missing_percent, min, max, mean, top): numbers have min, max and mean; others the
    most frequent value, the smallest on a tie."""
    kinds = {f.name: is_numeric(f) for f in df.schema.fields}
    rows = []
    for c, kind in df.dtypes:
        x, num = col_of(c), kinds[c]
        d = x.cast("double") if num else F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kind).alias("type"),
                F.count(x).alias("non_null"),
                F.count_if(x.isNull()).alias("missing"),
                F.bround(F.coalesce(F.try_divide(100.0 * F.count_if(x.isNull()), F.count("*")), F.lit(0.0)), 1).alias("missing_percent"),
                (F.min(d) if num else F.lit(None).cast("double")).alias("min"),
                (F.max(d) if num else F.lit(None).cast("double")).alias("max"),
                (F.round(F.avg(d), 4) if num else F.lit(None).cast("double")).alias("mean"),
            )
        )
    others = [c for c in df.columns if not kinds[c]]
    top = modes(df.select(*[col_of(c).cast("string").alias(c) for c in others]), others)
    out = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    named = F.create_map(*[F.lit(x).cast("string") for kv in top.items() for x in kv]) if top else F.lit(None)
    return out.withColumn("top", (named[F.col("column")] if top else named).cast("string"))


def _wrong_type(c):
    """Of a text column: failures, where over half of its values read as numbers and at least one does not."""
    ok = F.count_if(strip(c).rlike(NUMBER))
    bad = F.count(c) - ok
    return F.when((ok > 0.5 * F.count(c)) & (bad > 0), bad).otherwise(0).cast("long")


def type_errors(df):
    return per_column(df, text_columns(df), {"errors": _wrong_type}).where("errors > 0").select("column", "errors")


def future_dates(df, now):
    """(column, future): values after ``now`` (a timestamp text, so that results repeat)."""
    return per_column(df, time_columns(df), {"future": lambda c: F.count_if(c > F.lit(now).cast("timestamp_ntz"))}).select("column", "future")


def quality_report(df, now="2100-01-01 00:00:00"):
    """(metric, column, value): duplicates, nulls per column, type errors, future dates, score. Two jobs: one wide
    aggregation, and one grouping for duplicates."""
    row = lambda m, c, v: F.struct(F.lit(m).alias("metric"), F.lit(c).alias("column"), v.cast("double").alias("value"))
    rows = [row("rows", "", F.count("*"))]
    rows += [row("nulls", c, F.count_if(col_of(c).isNull())) for c in df.columns]
    rows += [row("type_errors", c, _wrong_type(col_of(c))) for c in text_columns(df)]
    rows += [row("future_dates", c, F.count_if(col_of(c) > F.lit(now).cast("timestamp_ntz"))) for c in time_columns(df)]
    wide = df.agg(F.array(*rows).alias("r"))
    both = wide.crossJoin(dup_count(df).select("duplicates"))  # one row each
    cells = F.filter("r", lambda x: x["metric"] == "rows")[0]["value"] * len(df.columns)
    wrong = F.aggregate(F.filter("r", lambda x: x["metric"].isin("nulls", "type_errors")), F.lit(0.0), lambda a, x: a + x["value"]) + F.col("duplicates")
    score = F.coalesce(F.bround(F.try_divide(100.0 * F.greatest(cells - wrong, F.lit(0.0)), cells), 1), F.lit(100.0))
    every = F.concat("r", F.array(row("duplicates", "", F.col("duplicates")), row("score", "", score)))
    return both.select(F.inline(every)).where("value > 0 or metric in ('rows', 'duplicates', 'score')")


def quality_score(df):
    return quality_report(df).where("metric = 'score'").select(F.col("value").alias("score"))


def risk_level(score):
    return F.when(score >= 85, "Low").when(score >= 60, "Medium").otherwise("High")


def quality_snapshot(df, top=7):
    """(item, column, value): rows, columns, nulls and duplicates with shares, and the columns with most nulls."""
    o = overview(df)
    pct = F.bround(F.coalesce(F.try_divide(100.0 * F.col("duplicates"), F.col("rows")), F.lit(0.0)), 2)
    items = {"rows": F.col("rows"), "columns": F.col("columns"), "null_cells": F.col("null_cells"), "null_percent": F.col("null_percent"), "duplicates": F.col("duplicates"), "duplicate_percent": pct}
    base = o.select(F.inline(F.array(*[F.struct(F.lit(k).alias("item"), F.lit("").alias("column"), v.cast("double").alias("value")) for k, v in items.items()])))
    most = null_summary(df).limit(top).select(F.lit("most_nulls").alias("item"), "column", F.col("missing").cast("double").alias("value"))
    return base.union(most)


def table_summary_json(df, order_by, sample=3, redact=False):
    """One row of JSON: columns with types, rows, duplicates, nulls per column, has_dates, sample rows (or "redacted")."""
    stats = df.agg(F.count("*").alias("rows"), F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.count_if(col_of(c).isNull()) for c in df.columns])).alias("nulls"))
    kinds = F.create_map(*[F.lit(x) for kv in df.dtypes for x in kv])
    out = stats.crossJoin(dup_count(df).select("duplicates"))
    if not redact:
        rows = df.orderBy(*[col_of(c) for c in order_by]).limit(sample).agg(F.collect_list(F.to_json(F.struct(*[col_of(c) for c in df.columns]))).alias("sample"))  # ``sample`` rows
        out = out.crossJoin(rows)
    else:
        out = out.withColumn("sample", F.array(F.lit("redacted")))
    return out.select(F.to_json(F.struct(kinds.alias("columns"), "rows", "duplicates", "nulls", F.lit(bool(time_columns(df))).alias("has_dates"), "sample")).alias("summary"))


def fingerprint(df):
    """(rows, fingerprint): a sum of row hashes, so the order of rows does not matter; nulls are told apart by position."""
    h = F.xxhash64(F.to_json(F.struct(*[col_of(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint"))


def categorical_cols(df):
    """(column, distinct_values): text columns, and others with few values: at most min(30, max(5, 20 % of rows))."""
    from .convert import type_table

    n = F.col("non_null") + F.col("missing")
    few = F.col("distinct_values") <= F.least(F.lit(30.0), F.greatest(F.lit(5.0), 0.2 * n))
    return type_table(df).where((F.col("type") == "string") | few).select("column", "distinct_values")


def date_like_cols(df, order_by, sample=40, least=0.65):
    """(column, reason): time columns, and text of whose first values ``least`` or more read as dates."""
    from .clean import date_share

    share = date_share(df, text_columns(df), order_by, sample)
    rows = [(c, "type") for c in time_columns(df)] + [(c, "values") for c, s in share.items() if s >= least]
    return df.sparkSession.createDataFrame(rows, "column string, reason string")


def category_share(df, column, top=3):
    """(value, n, share): the most frequent values and their share of the non-null."""
    counts = df.where(col_of(column).isNotNull()).groupBy(col_of(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.orderBy(F.desc("n"), "value").limit(top).crossJoin(total).select("value", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def date_coverage(df, columns=None):
    return per_column(df, columns or time_columns(df), {"first": lambda c: F.min(c).cast("timestamp_ntz"), "last": lambda c: F.max(c).cast("timestamp_ntz"), "valid": F.count})


def kpi_candidates(df):
    return per_column(df, numeric_columns(df), {"low": lambda c: F.min(c).cast("double"), "high": lambda c: F.max(c).cast("double")}).where("low is not null and low < high")


def findings(df, order_by):
    """(finding, subject, value): which checks apply."""
    from .outliers import outlier_summary

    snap = quality_snapshot(df)
    rows = snap.where("item = 'null_cells' and value > 0").select(F.lit("nulls").alias("finding"), F.lit("table").alias("subject"), F.col("value").cast("double").alias("value"))
    add = lambda d, name, subject, value: d.select(F.lit(name), F.col(subject).cast("string"), F.col(value).cast("double"))
    rows = rows.union(snap.where("item = 'duplicates' and value > 0").select(F.lit("duplicates"), F.lit("table"), F.col("value")))
    rows = rows.union(add(kpi_candidates(df), "kpi_candidate", "column", "high"))
    rows = rows.union(add(outlier_summary(df), "outliers", "column", "outliers"))
    rows = rows.union(add(categorical_cols(df), "categorical", "column", "distinct_values"))
    return rows.union(add(date_like_cols(df, order_by).withColumn("n", F.lit(1)), "dates", "column", "n"))
