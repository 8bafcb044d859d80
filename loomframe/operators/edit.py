"""Replace, compute, rename, delete, sort and deduplicate."""

import ast
import functools
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import NUMBER, col_of, literal_of, strip, text_columns


def replace_all(df, values, replacement):
    """Exact cells of text columns; ``values`` is comma-separated text, so numbers never match."""
    want = [v.strip() for v in values.split(",")]
    return df.withColumns({c: F.when(col_of(c).isin(want), F.lit(replacement)).otherwise(col_of(c)) for c in text_columns(df)})


def replace_regex_all(df, pattern, replacement):
    """In text columns: a text replaces each match, a number replaces the whole cell that has one."""
    if isinstance(replacement, str):
        return df.withColumns({c: F.regexp_replace(col_of(c), pattern, java_groups(replacement)) for c in text_columns(df)})
    return df.withColumns({c: F.when(col_of(c).rlike(pattern), F.lit(str(replacement))).otherwise(col_of(c)) for c in text_columns(df)})


def java_groups(replacement):
    """``\\1`` as ``$1``, a literal dollar escaped."""
    return re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))


def replace_exact_col(df, column, values, replacement):
    """One column as text; the values are replaced one after another."""
    c = col_of(column).cast("string")
    for v in values:
        c = F.when(c == v, F.lit(replacement)).otherwise(c)
    return df.withColumn(column, c)


def replace_regex_col(df, column, patterns, replacement):
    c = col_of(column).cast("string")
    for p in patterns:
        c = F.regexp_replace(c, p, java_groups(replacement))
    return df.withColumn(column, c)


def renumber(df, column):
    """The column as double if every value in it reads as a number, else unchanged."""
    s = strip(col_of(column).cast("string"))
    row = df.agg(F.count_if(s.isNotNull() & ~s.rlike(NUMBER)).alias("bad")).first()
    return df if row["bad"] else df.withColumn(column, F.when(s.rlike(NUMBER), s.try_cast("double")))


_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)),
    ast.Mod: F.try_mod,
    ast.Pow: F.pow,
}
_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}
_UNARY = {ast.USub: lambda a: -a, ast.UAdd: lambda a: a, ast.Not: lambda a: ~a, ast.Invert: lambda a: ~a}
_FUNCTIONS = {"abs": F.abs, "sqrt": F.sqrt, "log": F.ln, "log10": F.log10, "exp": F.exp}


def _column(formula, columns):
    """A formula, in Python's grammar, as a column: powers bind to the right, ``&`` and ``|`` are ``and`` and ``or``.

    ValueError for names that are no columns, functions not listed, anything but numbers, truth values and operators, and
    for a formula without a column or of more than 500 characters.
    """
    if not formula or len(formula) > 500:
        raise ValueError("a formula has 1 to 500 characters")
    quoted, known, used = [], {c.lower() for c in columns}, set()

    def held(m):
        quoted.append(m[1])
        return f"__q{len(quoted) - 1}__"

    text = re.sub(r"`([^`]+)`", held, formula).replace("&", " and ").replace("|", " or ").strip()

    def of(node):
        if isinstance(node, ast.Name):
            m = re.fullmatch(r"__q(\d+)__", node.id)
            name = quoted[int(m[1])] if m and int(m[1]) < len(quoted) else node.id
            if name.lower() in ("true", "false") and name.lower() not in known:
                return F.lit(name.lower() == "true")
            if name.lower() not in known:
                raise ValueError(f"unknown name: {name}")
            used.add(name.lower())
            return col_of(name)
        if isinstance(node, ast.Constant) and type(node.value) in (bool, int, float):
            return F.lit(node.value) if isinstance(node.value, bool) else F.expr(ast.get_source_segment(text, node))
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](of(node.left), of(node.right))
        if isinstance(node, ast.UnaryOp):
            return _UNARY[type(node.op)](of(node.operand))
        if isinstance(node, ast.BoolOp):
            return functools.reduce(lambda a, b: a & b if isinstance(node.op, ast.And) else a | b, map(of, node.values))
        if isinstance(node, ast.Compare) and all(type(op) in _COMPARE for op in node.ops):
            sides = [of(x) for x in (node.left, *node.comparators)]
            return functools.reduce(lambda a, b: a & b, [_COMPARE[type(op)](x, y) for op, x, y in zip(node.ops, sides, sides[1:])])
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and len(node.args) == 1 and not node.keywords and node.func.id.lower() in _FUNCTIONS:
            return _FUNCTIONS[node.func.id.lower()](of(node.args[0]))
        raise ValueError(f"not allowed in a formula: {ast.get_source_segment(text, node)}")

    try:
        out = of(ast.parse(text, mode="eval").body)
    except SyntaxError as e:
        raise ValueError(f"not a formula: {formula}") from e
    if not used:
        raise ValueError("a formula must use a column")
    return out


def computed_col(df, name, formula):
    """A new column by formula: arithmetic, comparison, and/or, unary signs, ``// % **``, abs sqrt log log10 exp;
    backticks around odd names. A null operand and a division by zero give null."""
    return df.withColumn(name, _column(formula, df.columns))


def drop_col(df, column):
    return df.drop(column)


def rename_col(df, old, new):
    return df.withColumnRenamed(old, new)


def delete_row(df, position, order_by):
    """Without the row at a 0-based position of the order; the rank comes from counting what lies before, not from a
    window over all rows."""
    top = df.select(*[col_of(c) for c in order_by]).orderBy(*[col_of(c) for c in order_by]).limit(position + 1)
    last = top.orderBy(*[col_of(c).desc() for c in order_by]).limit(1)
    n = top.count()
    return df if n <= position else df.join(F.broadcast(last), list(order_by), "left_anti").select(*[col_of(c) for c in df.columns])


def preview(df, order_by, n=10):
    return df.orderBy(*[col_of(c) for c in order_by]).limit(n)


def dedupe_full(df):
    return df.dropDuplicates()


def dedupe_subset(df, subset, order_by):
    """The first row, in the order given, of every combination of ``subset``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in subset]
    row = F.struct(*[col_of(c) for c in rest])
    out = df.groupBy(*[col_of(c) for c in subset]).agg(F.min_by(row, F.struct(*[col_of(c) for c in order_by])).alias("__row"))
    return out.select(*[col_of(c) if c in subset else F.col("__row").getField(c).alias(c) for c in df.columns])


def digest(columns):
    """Two 64-bit hashes of a row, nulls told apart from each other's places; equal rows have equal ones."""
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in columns])
    return [F.xxhash64(F.lit(seed), nulls, *columns).alias(name) for seed, name in ((1, "__d1"), (2, "__d2"))]


def _hashable(df):
    """Maps can't be hashed; a table that has one is grouped by its rows as before."""
    return not any("map<" in kind for _, kind in df.dtypes)


def repeated(df, columns):
    """The rows of ``df`` whose digest over ``columns`` occurs twice or more: 16 bytes a row are grouped to find them."""
    tagged = df.select("*", *digest([col_of(c) for c in columns]))
    often = tagged.groupBy("__d1", "__d2").agg(F.count("*").alias("__n")).where("__n > 1").select("__d1", "__d2")
    return tagged.join(often, ["__d1", "__d2"], "left_semi").select(*[col_of(c) for c in df.columns])


def dup_count(df):
    """(rows, duplicates, percent) of full-row repeats. Only rows whose digest repeats are compared in full."""
    some = repeated(df, df.columns) if df.columns and _hashable(df) else df
    groups = some.groupBy(*[col_of(c) for c in df.columns]).agg(F.count("*").alias("__n"))
    out = df.agg(F.count("*").alias("rows")).crossJoin(groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates")))  # one row each
    return out.withColumn("percent", F.bround(F.coalesce(F.try_divide(100.0 * F.col("duplicates"), F.col("rows")), F.lit(0.0)), 2))


def dup_sample(df, order_by, n=20):
    """The first ``n`` repeated rows (second and later ones) in the order given."""
    by = [c for c in df.columns if c not in order_by]
    w = Window.partitionBy(*[col_of(c) for c in by]).orderBy(*[col_of(c) for c in order_by])
    some = repeated(df, by) if by and _hashable(df) else df
    out = some.withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__n")
    return out.orderBy(*[col_of(c) for c in order_by]).limit(n)


def sort_col(df, column, descending=False, tie=()):
    c = col_of(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *[col_of(t) for t in tie])
