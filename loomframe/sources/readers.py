"""Sources: CSV, JSON documents and lines, Parquet, JDBC, tables by name, and checks of what lies in a landing folder."""

import re
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import NUMBER, col_of, denan
from .landing import landing

ENCODINGS = ["utf-8", "windows-1256", "iso-8859-1"]
#: Words that a read-only query may not hold.
WRITE_WORDS = ["insert", "update", "delete", "drop", "alter", "truncate", "create", "replace", "merge", "grant", "revoke", "vacuum", "attach", "detach", "pragma", "copy", "call", "execute"]


def check_select(query):
    """The query without a final semicolon, if it is one read-only statement; else ValueError."""
    q = query.strip().rstrip(";").strip()
    if not q:
        raise ValueError("empty query")
    if ";" in q:
        raise ValueError("one statement only")
    if not re.match(r"(?i)(select|with)\b", q):
        raise ValueError("a query begins with select or with")
    if m := re.search(rf"(?i)\b({'|'.join(WRITE_WORDS)})\b", q):
        raise ValueError(f"not allowed in a read-only query: {m[0]}")
    return q


def probe_encoding(spark, path, encodings=ENCODINGS):
    """The first encoding under which no line of the text holds U+FFFD; one distributed count each."""
    for e in encodings[:-1]:
        try:
            if not spark.read.option("encoding", e).option("lineSep", "\n").csv(path, sep="\x01", quote="").where(F.col("_c0").contains("�")).limit(1).count():
                return e
        except Exception as error:  # a charset that this session does not allow
            if "charset" not in str(error).lower() and "encoding" not in str(error).lower():
                raise
    return encodings[-1]


def read_csv(spark, path, encoding=None, schema=None, header=True, **options):
    """CSV with a header. Without a schema types are inferred; without an encoding it is probed."""
    reader = spark.read.options(header=header, encoding=encoding or probe_encoding(spark, path), **options)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return denan(strip_bom(reader.csv(path)))


def strip_bom(df):
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else df


def _arrays(df):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]


def json_array_candidates(doc):
    """(name, length) of the arrays at the root of JSON documents, longest first."""
    names = _arrays(doc)
    if not names:
        return doc.sparkSession.createDataFrame([], "name string, length long")
    rows = [F.struct(F.lit(n).alias("name"), F.coalesce(F.sum(F.size(col_of(n)).cast("long")), F.lit(0)).alias("length")) for n in names]
    return doc.agg(F.array(*rows).alias("r")).select(F.inline("r")).orderBy(F.desc("length"), "name")


def read_json_doc(spark, path, key=None):
    """A JSON document as a table: a root array gives rows, a root object its longest array (or ``key``), else one row."""
    doc = spark.read.option("multiLine", True).json(path)
    names = _arrays(doc)
    if key is not None and key not in names:
        raise ValueError(f"no array {key}; there are {names}")
    if not names:
        return denan(flatten(doc))
    key = key or json_array_candidates(doc).first()["name"]
    kind = doc.schema[key].dataType.elementType
    if not isinstance(kind, T.StructType):
        return doc.select(F.explode(col_of(key)).alias(key))
    return denan(flatten(doc.select(F.explode(col_of(key)).alias("__x")).select("__x.*")))


def read_jsonl(spark, path, schema=None):
    """JSON lines; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return denan(flatten(reader.json(path)))


def flatten(df):
    """Struct columns at any depth as dotted columns, at the end; lists stay; other columns keep place and type."""

    def leaves(kind, path):
        for f in kind.fields:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, at)
            else:
                yield at

    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.StructType)]
    deep = [p for f in df.schema.fields if isinstance(f.dataType, T.StructType) for p in leaves(f.dataType, [f.name])]
    if not deep:
        return df
    quoted = lambda p: F.col(".".join("`" + x.replace("`", "``") + "`" for x in p))
    return df.select(*[col_of(c) for c in plain], *[quoted(p).alias(".".join(p)) for p in deep])


def read_parquet(spark, path):
    return denan(spark.read.parquet(path))


def read_jdbc(spark, url, query, most=None, partition=None, **options):
    """(DataFrame, truncated) of a guarded SELECT. ``most`` caps rows exactly; ``partition`` = (column, low, high, n)
    reads in parallel."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    q = check_select(query)
    if partition:
        column, low, high, n = partition
        reader = reader.options(dbtable=f"({q}) q", partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n)
    else:
        reader = reader.option("query", q)
    df = reader.load()
    if most is None:
        return df, False
    return df.limit(most), df.limit(most + 1).count() > most


def masked_url(url):
    """A connection URL with its password hidden."""
    return re.sub(r"((?i:password)=)[^;&]*", r"\1***", re.sub(r"//([^:/@]+):[^@]*@", r"//\1:***@", url))


def database_catalog(spark, url, schema=None, parallel=8, **options):
    """(name, kind, rows) of a database's tables and views, by kind and name, as its own metadata tell them.

    Each is counted by the database itself, several at once; ``rows`` is null where a count fails, as
    for a view that no longer resolves. ``schema`` restricts the search; names outside the default schema keep
    theirs in front. System tables are left out.
    """
    jvm = spark.sparkContext._jvm
    if "driver" in options:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    props = jvm.java.util.Properties()
    for k, v in options.items():
        props.setProperty(k, str(v))

    def ask(use):
        con = jvm.java.sql.DriverManager.getConnection(url, props)
        try:
            return use(con)
        finally:
            con.close()

    def names(con):
        kinds = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 2)
        kinds[0], kinds[1] = "TABLE", "VIEW"
        rows, out = con.getMetaData().getTables(con.getCatalog(), schema, "%", kinds), []
        while rows.next():
            out.append((rows.getString("TABLE_SCHEM"), rows.getString("TABLE_NAME"), rows.getString("TABLE_TYPE").lower()))
        return con.getSchema(), con.getMetaData().getIdentifierQuoteString().strip(), out

    default, quote, found = ask(names)
    quoted = lambda x: quote + x.replace(quote, quote * 2) + quote if quote else x

    def count(one):
        of, name, kind = one
        at = ".".join(quoted(x) for x in (of, name) if x)

        def rows(con):
            got = con.createStatement().executeQuery(f"SELECT count(*) FROM {at}")
            got.next()
            return int(got.getLong(1))

        try:
            n = ask(rows)
        except Py4JJavaError:  # whatever the database says, the catalog goes on
            n = None
        return name if not of or of == default else f"{of}.{name}", kind, n

    with ThreadPoolExecutor(parallel) as pool:
        counted = list(pool.map(count, found))
    return spark.createDataFrame(counted, "name string, kind string, rows long").orderBy("kind", "name")


def largest_of(catalog):
    """The entry of a catalog with most rows; on a tie the first by name; entries without a count come last."""
    return catalog.orderBy(F.desc_nulls_last("rows"), "name").limit(1)


def table_inventory(tables):
    """(name, kind, rows) of named DataFrames, by kind and name."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), F.lit("table").alias("kind"), "rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.orderBy("kind", "name")


def largest_table(tables):
    """The table with most rows; on a tie the first by name."""
    return largest_of(table_inventory(tables))


def sql_select(spark, query, tables):
    """A guarded SELECT over named DataFrames."""
    q = check_select(query)
    for n, df in tables.items():
        df.createOrReplaceTempView(n)
    return spark.sql(q)


def header_row(cells, file="file", line="line", most=15):
    """(file, header_line): per file the line that looks most like a header, among its first ``most``.

    ``cells`` has one row a line: file, line number from 0, ``cells`` an array of texts. Score: 2 x text share + 1.5 x
    unique share - 2 x numeric share + filled share; first on ties; lines without a value are skipped.
    """
    filled = F.filter("cells", lambda x: x.isNotNull() & (F.trim(x) != ""))
    n = F.size("v")
    numeric = F.size(F.filter("v", lambda x: F.trim(x).rlike(NUMBER)))
    rows = cells.where(F.col(line) < most).withColumn("v", filled).where(F.size("v") > 0)
    score = 2.0 * (n - numeric) / n + 1.5 * F.size(F.array_distinct("v")) / n - 2.0 * numeric / n + n / F.size("cells")
    best = rows.groupBy(col_of(file).alias("file")).agg(F.max_by(col_of(line), F.struct(F.round(score, 9).alias("s"), (-col_of(line)).alias("l"))).alias("header_line"))
    return best


def csv_cells(spark, path, sep=",", most=15):
    """The first ``most`` records of CSV files as (file, line, cells), counted inside each file from 0; quotes are honoured
    and no more of a file is read."""
    return landing(spark, path, most, sep).select(F.col("path").alias("file"), F.posexplode("records").alias("line", "cells"))


#: First bytes, in hex, of file kinds.
MAGIC = {"xlsx": ["504B0304"], "xls": ["D0CF11E0A1B11AE1"], "parquet": ["50415231"], "db": ["53514C69746520666F726D6174203300"], "sqlite": ["53514C69746520666F726D6174203300"]}
TEXT_SUFFIXES = ["csv", "json", "jsonl", "ndjson", "txt"]


def file_audit(spark, path, most=100 * 1024 * 1024):
    """(path, length, suffix, verdict) of the files under ``path``: empty, too large, unknown suffix, wrong content or ok.
    Only the beginning of a file is read, whatever its size."""
    files = landing(spark, path)
    head = F.hex(F.substring("head", 1, 16))
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    fits = F.lit(False)
    for s, starts in MAGIC.items():
        for m in starts:
            fits = fits | ((suffix == s) & head.startswith(m))
    text = suffix.isin(TEXT_SUFFIXES) & ~head.rlike("^(?:[0-9A-F]{2})*?00") & ~head.startswith("504B0304") & ~head.startswith("50415231")
    verdict = F.when(F.col("length") == 0, "empty").when(F.col("length") > most, "too large").when(~suffix.isin([*MAGIC, *TEXT_SUFFIXES]), "unknown suffix").when(fits | text, "ok").otherwise("wrong content")
    return files.select("path", "length", suffix.alias("suffix"), verdict.alias("verdict"))


LOADERS = {"csv": read_csv, "txt": read_csv, "json": read_json_doc, "jsonl": read_jsonl, "ndjson": read_jsonl, "parquet": read_parquet}


def load(spark, path, format=None):
    """By suffix, or by the format named; SQL dumps are refused."""
    kind = (format or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind not in LOADERS:
        raise ValueError(f"no reader for {kind}")
    return LOADERS[kind](spark, path)
