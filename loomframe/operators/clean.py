"""Cleaning on import: names, white space, fake nulls, booleans, dates, empty rows and columns."""

from pyspark.sql import functions as F

from ..functions.expr import col_of, strip, text_columns
from .ranks import first_values

#: Cells that mean "no value", compared whole and without case.
FAKE_NULLS = ["nan", "none", "null", "na", "n/a", "", "–", "-", "--", "?", "<na>"]
#: The same for the page version.
FAKE_NULLS_PAGE = [*FAKE_NULLS, "missing"]
#: What reads as yes and as no.
YES = ["yes", "true", "1", "y", "نعم", "صح"]
NO = ["no", "false", "0", "n", "لا", "خطأ"]
BLANK_NAMES = ["", "nan", "none", "unnamed: 0"]
#: Tried in this order, day first; the first that parses wins.
DATE_FORMATS = ["yyyy-M-d H:m:s", "yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "M/d/yyyy", "yyyy/M/d", "d MMM yyyy", "yyyyMMdd"]


def clean_names(df):
    """Trimmed names; blank ones become column_{position}; repeats get _2, _3, ..."""
    seen, out = {}, []
    for i, c in enumerate(df.columns):
        c = c.strip()
        c = f"column_{i + 1}" if c.lower() in BLANK_NAMES else c
        seen[c] = seen.get(c, 0) + 1
        out.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    return df.toDF(*out)


def strip_strings(df, columns=None):
    return df.withColumns({c: strip(col_of(c)) for c in columns or text_columns(df)})


def is_fake_null(c, values=FAKE_NULLS):
    return F.lower(strip(c)).isin(values)


def fake_nulls(df, columns=None, values=FAKE_NULLS):
    """Text cells that only say that there is no value become null; null stays null."""
    return df.withColumns({c: F.when(~is_fake_null(col_of(c), values), col_of(c)) for c in columns or text_columns(df)})


def fake_null_counts(df, columns=None, values=FAKE_NULLS):
    from ..functions.expr import per_column

    return per_column(df, columns or text_columns(df), {"fake_nulls": lambda c: F.count_if(is_fake_null(c, values))})


def _flag(c):
    low = F.lower(strip(c))
    return F.when(low.isin(YES), "Yes").when(low.isin(NO), "No")


def bool_standardise(df, columns=None, least=0.7):
    """Text columns of which more than ``least`` of the non-null cells read as yes or no: those cells become Yes or No."""
    cols = columns or text_columns(df)
    if not cols:
        return df
    share = df.agg(*[F.try_divide(F.count(_flag(col_of(c))), F.count(col_of(c))).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    fit = [c for i, c in enumerate(cols) if (share[i] or 0) > least]
    return df.withColumns({c: F.coalesce(_flag(col_of(c)), col_of(c)) for c in fit}) if fit else df


def as_date(c, formats=DATE_FORMATS):
    s = strip(c)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])


def date_share(df, columns, order_by=None, sample=30):
    """{column: share of its first ``sample`` non-null values that read as dates}; one job for all columns."""
    found = first_values(df, columns, order_by, sample).groupBy("i").agg((F.count(as_date(F.col("v"))) / F.count("*")).alias("share")).collect() if columns else []
    return {c: 0.0 for c in columns} | {columns[r["i"]]: r["share"] for r in found}


def date_detect(df, columns=None, order_by=None, sample=30, least=0.65):
    """Text columns of which over ``least`` of the first values read as dates become timestamps; failures become null."""
    share = date_share(df, columns or text_columns(df), order_by, sample)
    fit = [c for c, s in share.items() if s > least]
    return df.withColumns({c: as_date(col_of(c)).cast("timestamp_ntz") for c in fit}) if fit else df


def drop_empty_rows(df):
    return df.dropna(how="all")


def empty_columns(df):
    row = df.agg(*[F.count(col_of(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if not row[i]]


def drop_empty_cols(df):
    """Without the columns that hold no value at all; a table without rows keeps none."""
    return df.drop(*empty_columns(df))


def cleaning_report(df):
    """(action, detail, n, severity): what the cleaning steps would do, from one aggregation over all columns."""
    texts = text_columns(df)
    every = [col_of(c) for c in df.columns]
    steps = []
    for c in texts:
        x = col_of(c)
        steps.append(("strip", c, F.count_if(x != strip(x)), "info"))
        steps.append(("fake_nulls", c, F.count_if(is_fake_null(x)), "warning"))
    empty = F.lit(True)
    for x in every:
        empty = empty & x.isNull()
    steps.append(("drop_empty_rows", "", F.count_if(empty), "removed"))
    steps += [("drop_empty_cols", c, F.when(F.count(col_of(c)) == 0, F.lit(1)).otherwise(F.lit(0)).cast("long"), "removed") for c in df.columns]
    rows = [F.struct(F.lit(a).alias("action"), F.lit(d).alias("detail"), F.coalesce(n, F.lit(0)).cast("long").alias("n"), F.lit(s).alias("severity")) for a, d, n, s in steps]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).where("n > 0")


def clean(df, order_by=None):
    """All steps in order: names, strip, fake nulls, booleans, dates, empty rows, empty columns."""
    out = bool_standardise(fake_nulls(strip_strings(clean_names(df))))
    return drop_empty_cols(drop_empty_rows(date_detect(out, order_by=order_by)))
