"""Exact quantiles, modes and numbering whose state does not grow with the number of distinct values."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import col_of
from ..functions.work import Scratch

#: Buckets that a bracket of values is cut into; values that are gathered and sorted at once, all brackets together.
BUCKETS, FEW = 4096, 100_000
#: Counters of a column's hash buckets, and how many of the fullest are counted value by value first.
COUNTERS, FULLEST = 65_536, 32

_INF = float("inf")


def _bucket(x, lo, hi, n=BUCKETS):
    """The bucket, 0 .. n-1, of lo <= x <= hi (columns, lo < hi, of one sign): never falls as x rises, lo's is the first
    and hi's the last. Equal widths, or equal ratios where the bounds are far apart, so that each pass narrows a bracket
    by about n whatever the spread."""
    share = F.when((lo > 0) & (hi > 4 * lo), (F.log(x) - F.log(lo)) / (F.log(hi) - F.log(lo)))
    share = share.when((hi < 0) & (lo < 4 * hi), 1 - (F.log(-x) - F.log(-hi)) / (F.log(-lo) - F.log(-hi)))
    share = share.otherwise((x - lo) / (hi - lo))
    inner = F.least(F.greatest(F.floor(share * n), F.lit(0)), F.lit(n - 1)).cast("int")
    return F.when(x == lo, 0).when(x == hi, n - 1).otherwise(inner)


def _segments(x):
    """[(count, lowest, highest)] of minus infinity, negative, zero, positive, infinity and NaN, which sorts last."""
    neg, pos = (x < 0) & (x > -_INF), (x > 0) & (x < _INF)
    fixed = lambda v: (F.count_if(F.isnan(x) if v != v else x == v), F.lit(v), F.lit(v))
    span = lambda t: (F.count_if(t), F.min(F.when(t, x)), F.max(F.when(t, x)))
    return [fixed(-_INF), span(neg), fixed(0.0), span(pos), fixed(_INF), fixed(float("nan"))]


def _struct(seg):
    return F.struct(seg[0].alias("n"), seg[1].cast("double").alias("lo"), seg[2].cast("double").alias("hi"))


def _octave(x, steps):
    """A number that never falls as x rises: by sign, then by ``steps`` an octave; zeros, infinities and NaN apart."""
    size = lambda v: 100_000 + F.floor(F.log2(v) * steps)
    finite = F.when(x == 0, 0).when(x > 0, size(x)).otherwise(-size(-x))
    return F.when(F.isnan(x), 3_000_000).when(x == _INF, 2_000_000).when(x == -_INF, -2_000_000).otherwise(finite).cast("int")


def _counted(df, cells):
    """{b: [(k, n, lo, hi) by k]} of structs (b, k, x), null ones left out."""
    by = {}
    rows = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.b", "c.k").agg(F.count("*").alias("n"), F.min("c.x").alias("lo"), F.max("c.x").alias("hi"))
    for r in sorted(rows.collect(), key=lambda r: r["k"]):
        by.setdefault(r["b"], []).append(r)
    return by


def _place(p, n):
    at = p * (n - 1)
    return at, math.floor(at), math.ceil(at)


def quantiles(df, columns, probs, few=FEW):
    """{column: [value of each of ``probs``]}, interpolated between neighbouring ranks; None for a column without values.

    Columns are read as double; nulls don't count, NaN sorts last. One job counts every column by sign and size, 16 steps an
    octave; brackets that hold a wanted rank and more than ``few`` values (all together) are cut into buckets and counted, and
    only the bucket with the rank is looked at further; then the few values left are sorted. Two jobs for up to some dozen times
    ``few`` values, three for 4,096 times as many. What reaches the driver are counts: a few thousand rows a bracket and pass.
    """
    if not columns:
        return {}
    cols = {c: col_of(c).cast("double") for c in columns}
    steps = max(1, min(16, 4000 // len(columns)))
    cells = [F.when(x.isNotNull(), F.struct(F.lit(i).alias("b"), _octave(x, steps).alias("k"), x.alias("x"))) for i, x in enumerate(cols.values())]
    by = _counted(df, cells)
    known, brackets, counts = {}, [], {}
    for i, c in enumerate(cols):
        before, counts[c] = 0, sum(r["n"] for r in by.get(i, []))
        wanted = {r for p in probs for r in _place(p, counts[c])[1:]} if counts[c] else set()
        for r in by.get(i, []):
            brackets.append((c, r["lo"], r["hi"], before, r["n"], [w for w in wanted if before <= w < before + r["n"]]))
            before += r["n"]

    def settle(found):
        """Brackets still open; the others' ranks are known."""
        left = []
        for b in found:
            if b[5] and (b[1] == b[2] or b[1] != b[1]):
                known.update({(b[0], r): b[1] for r in b[5]})
            elif b[5]:
                left.append(b)
        return left

    brackets = settle(brackets)
    while big := [b for b in brackets if b[4] > max(64, few // len(brackets))]:
        n = max(16, min(BUCKETS, 400_000 // len(big)))
        cells = [F.when((cols[c] >= lo) & (cols[c] <= hi), F.struct(F.lit(i).alias("b"), _bucket(cols[c], F.lit(lo), F.lit(hi), n).alias("k"), cols[c].alias("x"))) for i, (c, lo, hi, *_) in enumerate(big)]
        by = _counted(df, cells)
        new = [b for b in brackets if b not in big]
        for i, (c, _, _, before, _, wanted) in enumerate(big):
            for r in by[i]:
                new.append((c, r["lo"], r["hi"], before, r["n"], [w for w in wanted if before <= w < before + r["n"]]))
                before += r["n"]
        brackets = settle(new)
    if brackets:
        picks = []
        for c, lo, hi, before, _, wanted in brackets:
            held = F.sort_array(F.collect_list(F.when((cols[c] >= lo) & (cols[c] <= hi), cols[c])))
            picks.append(F.array(*[F.get(held, F.lit(r - before)) for r in wanted]))
        got = df.agg(*[p.alias(f"p{i}") for i, p in enumerate(picks)]).first()
        for i, b in enumerate(brackets):
            known.update({(b[0], r): v for r, v in zip(b[5], got[i])})

    def between(c, p):
        at, lower, upper = _place(p, counts[c])
        a, b = known[c, lower], known[c, upper]
        return a if a == b or lower == upper else (upper - at) * a + (at - lower) * b

    return {c: [between(c, p) if counts[c] else None for p in probs] for c in cols}


def with_quantiles(rows, df, columns, named, digits):
    """``rows`` (one a column, named in ``column``) plus the rounded quantiles of each: {output name: share}."""
    found = quantiles(df, columns, list(named.values()))
    if not found:
        return rows.withColumns({n: F.lit(None).cast("double") for n in named})
    table = F.create_map(*[x for c, v in found.items() for x in (F.lit(c), F.array(*[F.lit(q).cast("double") for q in v]))])
    return rows.withColumns({n: F.round(F.get(F.element_at(table, F.col("column")), F.lit(i)), digits) for i, n in enumerate(named)})


def grouped_quantiles(df, column, group, probs, few=10_000):
    """(grp, q): the same for every group, ``q`` an array in the order of ``probs``; the null group is one of them.

    Brackets are rows here, one a group and wanted rank, so neither the number of groups nor a group's size meets in one
    place: a group of more than ``few`` values in a bracket is counted by buckets, in parallel, until it has fewer.
    """
    work = Scratch(df.sparkSession, "quantiles")
    x = df.select(col_of(group).alias("g"), col_of(column).cast("double").alias("x")).where("x is not null")
    segs = x.groupBy("g").agg(F.count("*").alias("total"), F.array(*[_struct(s) for s in _segments(F.col("x"))]).alias("s"))
    place = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*[f(at).cast("long") for at in place for f in (F.floor, F.ceil)]))
    before = lambda i: F.aggregate(F.slice("s", 1, i), F.lit(0).cast("long"), lambda a, v: a + v["n"])
    held = F.transform("s", lambda v, i: F.struct(before(i).alias("before"), v["n"].alias("n"), v["lo"].alias("lo"), v["hi"].alias("hi")))
    here = (F.col("rank") >= F.col("v.before")) & (F.col("rank") < F.col("v.before") + F.col("v.n"))
    brackets = work.write(segs.select("g", F.explode(ranks).alias("rank"), held.alias("s")).select("g", "rank", F.explode("s").alias("v")).where(here).select("g", "rank", "v.*"))
    same = lambda a, b: a["g"].eqNullSafe(b["g"])
    inside = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    spread = lambda b, more: b.where(F.col("lo") < F.col("hi")).where(more)
    keys = lambda b: b.select("g", "before", "lo", "hi").distinct()
    while spread(brackets, F.col("n") > few).limit(1).count():
        big = spread(brackets, F.col("n") > few)
        k = keys(big)
        met = x.join(k, same(x, k)).where(inside).select(k["g"], "before", "x", _bucket(F.col("x"), F.col("lo"), F.col("hi")).alias("k"))
        hist = met.groupBy("g", "before", "k").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        up_to = F.sum("n").over(Window.partitionBy("g", "before").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
        hist = hist.withColumn("at", F.col("before") + F.coalesce(up_to, F.lit(0)))
        old = big.select(F.col("g").alias("og"), "rank", F.col("before").alias("ob"))
        new = old.join(hist, F.col("og").eqNullSafe(F.col("g")) & (F.col("ob") == F.col("before")))
        new = new.where((F.col("rank") >= F.col("at")) & (F.col("rank") < F.col("at") + F.col("n"))).select("g", "rank", F.col("at").alias("before"), "n", "lo", "hi")
        rest = brackets.where(~((F.col("lo") < F.col("hi")) & (F.col("n") > few)))
        brackets = work.write(rest.unionByName(new))
    open_, flat = spread(brackets, F.lit(True)), brackets.where(~(F.col("lo") < F.col("hi")))
    k = keys(open_)
    few_of = x.join(k, same(x, k)).where(inside).groupBy(k["g"], "before").agg(F.sort_array(F.collect_list("x")).alias("held"))
    old = open_.select(F.col("g").alias("og"), "rank", F.col("before").alias("ob"))
    picked = old.join(few_of, F.col("og").eqNullSafe(F.col("g")) & (F.col("ob") == F.col("before"))).select("g", "rank", F.get("held", (F.col("rank") - F.col("before")).cast("int")).alias("v"))
    values = flat.select("g", "rank", F.col("lo").alias("v")).unionByName(picked).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))
    totals = segs.select(F.col("g").alias("grp"), "total")
    out = totals.join(values, F.col("grp").eqNullSafe(F.col("g")))

    def between(at):
        lower, upper = F.floor(at).cast("long"), F.ceil(at).cast("long")
        a, b = F.element_at("m", lower), F.element_at("m", upper)
        return F.when(a == b, a).otherwise((upper - at) * a + (at - lower) * b)

    return out.select("grp", F.array(*[between(at) for at in place]).alias("q"))


def modes(df, columns):
    """{column: most frequent non-null value, the smallest on a tie}; None for a column without values.

    First a table of hash counters bounds how often any value of a hash bucket can occur. The fullest buckets are
    counted value by value; the best count found there rules out every bucket that holds fewer rows altogether. Only if buckets
    are left is a second count needed, of their values. Counts are grouped in parallel and combined before each shuffle.
    """
    out = {}
    for at in range(0, len(columns), 32):
        out.update(_modes(df, columns[at : at + 32]))
    return out


def _modes(df, columns):
    if not columns:
        return {}
    base = df.select(*[col_of(c).alias(f"v{i}") for i, c in enumerate(columns)])
    h = [F.pmod(F.xxhash64(f"v{i}"), F.lit(COUNTERS)).cast("int") for i in range(len(columns))]
    filled = F.array_compact(F.array(*[F.when(F.col(f"v{i}").isNotNull(), F.struct(F.lit(i).alias("i"), h[i].alias("h"))) for i in range(len(columns))]))
    counters = base.select(F.explode(filled).alias("c")).groupBy("c.i", "c.h").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "h"))
    fullest = {}
    counted = counters.withColumn("r", rank).where(F.col("r") <= FULLEST + 1).collect()  # a few rows a column
    for r in counted:
        fullest.setdefault(r["i"], []).append((r["n"], r["h"]))

    def count(test):
        """{i: (count, value)} of the best value of each column among the rows that pass ``test[i]``."""
        kept = base.select(*[(F.when(test[i], F.col(f"v{i}")) if i in test else F.lit(None).cast(base.schema[i].dataType)).alias(f"v{i}") for i in range(len(columns))])
        names = [f"v{i}" for i in sorted(test)]
        sets = kept.groupingSets([[n] for n in names], *names).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
        mine = lambda j, name: (F.col("gid") == (1 << len(names)) - 1 - (1 << (len(names) - 1 - j))) & F.col(name).isNotNull()
        row = sets.agg(*[F.min(F.when(mine(j, n), F.struct((-F.col("n")).alias("n"), F.col(n).alias("v")))).alias(n) for j, n in enumerate(names)]).first()
        return {int(n[1:]): (-row[n]["n"], row[n]["v"]) for n in names if row[n] is not None}

    first = {i: h[i].isin([b for _, b in sorted(f, reverse=True)[:FULLEST]]) for i, f in fullest.items()}
    best = count(first) if first else {}
    # a bucket beyond the fullest may hold a value as frequent only if it has as many rows
    again = {i: max(best[i][0], 1) for i, f in fullest.items() if len(f) > FULLEST and min(f)[0] >= best[i][0]}
    if again:
        left = {}
        for i, least in again.items():
            few = [r["h"] for r in counters.where((F.col("i") == i) & (F.col("n") >= least)).select("h").limit(2049).collect()]
            left[i] = h[i].isin(few) if len(few) <= 2048 else F.lit(True)
        best.update(count(left))
    return {c: best[i][1] if i in best else None for i, c in enumerate(columns)}


def numbered(values, column, out="number", rows=250_000):
    """``values`` (distinct, not null in ``column``) plus ``out``: 0, 1, 2 ... in rising order, numbered in parallel.

    Sampled bounds deal the values into ranges, each range is numbered by itself, and the ranges' counts, summed up, say
    where each begins.
    """
    spark = values.sparkSession
    work = Scratch(spark, "numbered")
    held = work.write(values)
    n = held.count()
    parts = max(1, min(4096, max(n // rows + 1, min(n // 1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    dealt = held.repartitionByRange(parts, col_of(column)).withColumn("__part", F.spark_partition_id())
    dealt = work.write(dealt)
    sizes = {r[0]: r[1] for r in dealt.groupBy("__part").agg(F.count("*")).collect()}  # at most ``parts`` rows
    first, total = {}, 0
    for p in sorted(sizes):
        first[p], total = total, total + sizes[p]
    starts = F.element_at(F.create_map(*[F.lit(v).cast("long") for kv in first.items() for v in kv]), F.col("__part").cast("long")) if first else F.lit(0).cast("long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(col_of(column))) - 1
    return dealt.withColumn(out, (starts + place).cast("int" if total < 2**31 else "long")).drop("__part")


def first_values(df, columns, order_by=None, n=30):
    """(i, v): the first ``n`` non-null values, as text, of each of ``columns`` (by their number), in one job.

    Rows are cut to the first ``n`` a column inside every task before they are shuffled (the planner's limit on
    a ranked window), so one task's state and what is shuffled are ``n`` rows a column.
    """
    order = [col_of(order_by)] if order_by else [F.monotonically_increasing_id()]
    cells = [F.when(col_of(c).isNotNull(), F.struct(F.lit(i).alias("i"), col_of(c).cast("string").alias("v"))) for i, c in enumerate(columns)]
    long = df.select(F.struct(*[o.alias(f"o{j}") for j, o in enumerate(order)]).alias("o"), F.explode(F.array_compact(F.array(*cells))).alias("c"))
    ranked = long.select("o", "c.*").withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("o")))
    return ranked.where(F.col("r") <= n).select("i", "v")
