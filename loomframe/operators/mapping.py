"""Mapping column names to semantic groups, and masking by name."""

from pyspark.sql import functions as F

from ..functions.expr import col_of, per_column

#: Our own lexicon: group -> words that a column name may be or contain. Taken from the column names of the test tables and of
#: common business schemas, with everyday Arabic words for the same things.
LEXICON = {
    "identifier": ["id", "key", "code", "uuid", "number", "رقم"],
    "date": ["date", "day", "month", "year", "timestamp", "ts", "تاريخ"],
    "time": ["time", "hour", "minute", "duration"],
    "money": ["price", "amount", "cost", "revenue", "balance", "salary", "acctbal", "total price", "سعر", "مبلغ"],
    "discount": ["discount", "rebate", "tax", "fee"],
    "quantity": ["quantity", "qty", "count", "size", "units", "كمية"],
    "person": ["name", "customer name", "employee", "owner", "اسم"],
    "customer": ["customer", "client", "cust", "account", "عميل"],
    "supplier": ["supplier", "vendor", "supp", "مورد"],
    "product": ["product", "part", "item", "brand", "sku", "منتج"],
    "order": ["order", "invoice", "purchase", "طلب"],
    "location": ["city", "country", "nation", "region", "address", "مدينة"],
    "contact": ["email", "phone", "mobile", "fax", "هاتف"],
    "status": ["status", "state", "flag", "stage", "priority", "حالة"],
    "category": ["category", "type", "segment", "class", "label", "نوع"],
    "text": ["text", "comment", "description", "note", "props", "وصف"],
    "measure": ["value", "score", "rate", "ratio", "percent", "نسبة"],
}
#: Name parts that mark personal data.
PII_WORDS = ["name", "phone", "mobile", "email", "mail", "national", "id", "ssn", "اسم", "هاتف", "جوال", "بريد", "هوية", "رقم قومي"]


def lexicon(spark, groups=LEXICON):
    rows = [(g, w, n) for n, (g, w) in enumerate((g, w) for g, ws in groups.items() for w in ws)]
    return spark.createDataFrame(rows, "semantic_group string, keyword string, ord int")


def catalog_columns(tables):
    """(table_name, column_name, filled) of named DataFrames: every column with the number of its values, one pass a table."""
    out = None
    for t, df in tables.items():
        one = per_column(df, df.columns, {"filled": F.count}, "column_name").select(F.lit(t).alias("table_name"), "column_name", "filled")
        out = one if out is None else out.union(one)
    return out


def semantic_map(columns, words, column="column_name"):
    """The best group of each column name with its score: 1.0 equal, 0.85 prefix or suffix, 0.65 contained either way;
    longer keyword, then first listed, on ties; no match: unknown, 0. ``words`` is the lexicon, a small table that we write."""
    n = F.trim(F.regexp_replace(F.lower(col_of(column)), "[_-]", " "))
    k = F.col("keyword")
    score = F.when(F.col("__n") == k, 1.0).when(F.startswith("__n", k) | F.endswith("__n", k), 0.85).when(F.contains("__n", k) | F.contains(k, "__n"), 0.65).otherwise(0.0)
    pairs = columns.withColumn("__n", n).crossJoin(F.broadcast(words)).withColumn("score", score)
    best = pairs.groupBy(*[col_of(c) for c in columns.columns]).agg(F.max_by(F.struct("semantic_group", "score"), F.struct("score", F.length("keyword"), (-F.col("ord")).alias("o"))).alias("b"))
    group = F.when(F.col("b.score") > 0, F.col("b.semantic_group")).otherwise("unknown")
    return best.select(*[col_of(c) for c in columns.columns], group.alias("semantic_group"), F.col("b.score").alias("score"))


def mapping_label(score):
    return F.when(score >= 0.85, "auto_accepted").when(score >= 0.6, "verify").when(score >= 0.3, "suspicious").otherwise("unknown")


def mapping_summary(mapped):
    """One row: percent of each label, overall = (auto + 0.6 verify + 0.3 suspicious) / total, in percent, and the percent
    of all filled cells that lie in columns with a group."""
    label = mapping_label(F.col("score"))
    part = lambda k: F.coalesce(F.try_divide(100.0 * F.count_if(label == k), F.count("*")), F.lit(0.0))
    names = ("auto_accepted", "verify", "suspicious", "unknown")
    overall = part("auto_accepted") + 0.6 * part("verify") + 0.3 * part("suspicious")
    return mapped.agg(*[F.bround(part(k), 1).alias(k) for k in names], F.bround(overall, 1).alias("overall"), F.bround(F.coalesce(F.try_divide(100.0 * F.sum(F.when(F.col("score") > 0, F.col("filled")).otherwise(0)), F.sum("filled")), F.lit(0.0)), 1).alias("mapped_cells"))


def mapping_override(mapped, overrides, on=("table_name", "column_name")):
    """The user's group where there is one, approved with score 1; weak marks scores under 0.6."""
    more = [c for c in mapped.columns if c not in (*on, "semantic_group", "score")]
    o = overrides.select(*on, F.col("semantic_group").alias("__g"))
    out = mapped.join(o, list(on), "left")
    score = F.when(F.col("__g").isNotNull(), 1.0).otherwise(F.col("score"))
    return out.select(*on, *[col_of(c) for c in more], F.coalesce("__g", "semantic_group").alias("semantic_group"), score.alias("score"), F.col("__g").isNotNull().alias("approved"), (score < 0.6).alias("weak"))


def mask_pii(df, words=PII_WORDS, value="***", whole_word=False):
    """Every column whose name contains one of the words, as a constant. ``whole_word`` spares names such as ``width``."""
    hit = lambda c: any(w in c.lower().replace("-", "_").split("_") if whole_word else w in c.lower() for w in words)
    at = {c: F.lit(value) for c in df.columns if hit(c)}
    return df.withColumns(at) if at else df
