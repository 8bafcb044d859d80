"""Exact quantiles, modes and numbering in bounded state, against Spark's own buffers and plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomframe.operators import clean, features, nulls, outliers, ranks, stats

SHAPES = {
    "even": lambda r: float(r.randint(0, 10**6)),
    "ties": lambda r: float(r.choice([1, 1, 1, 2, 3, -4])),
    "spread": lambda r: r.choice([-1, 1]) * 10.0 ** r.randint(-300, 300) * r.random(),
    "close": lambda r: 1.0 + r.randint(0, 50) * 2.0**-52,
    "tiny": lambda r: r.randint(-9, 9) * 5e-324,
    "odd": lambda r: r.choice([float("inf"), float("-inf"), 0.0, -0.0, 1.5, -2.5, None, None]),
    "same": lambda r: 7.25,
    "none": lambda r: None,
}
PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def shapes(spark):
    rng = random.Random(11)
    rows = [(i, i % 7 if i % 3 else 1, *(f(rng) for f in SHAPES.values())) for i in range(3000)]
    rows.append((3000, None, *[None] * len(SHAPES)))
    return spark.createDataFrame(rows, "id long, g int, " + ", ".join(f"`{k}` double" for k in SHAPES)).repartition(4).persist()


def same(a, b):
    return (a is None and b is None) or a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b)) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12))


@pytest.mark.parametrize("few", [70, 2000, 10**6])
def test_quantiles(shapes, few):
    cols = list(SHAPES)
    got = ranks.quantiles(shapes, cols, PROBS, few)
    want = shapes.agg(*[F.percentile(c, F.array(*map(F.lit, PROBS))).alias(c) for c in cols]).first()
    for c in cols:
        assert all(same(a, b) for a, b in zip(got[c], want[c] or [None] * len(PROBS))), c


def test_quantiles_nan_empty_names(spark, shapes):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (2.0, 3)], "`a.b` double, n int")
    assert same(ranks.quantiles(df, ["a.b"], [1.0])["a.b"][0], float("nan")) and ranks.quantiles(df, ["a.b"], [0.5])["a.b"] == [2.0]
    assert ranks.quantiles(df.limit(0), ["n"], [0.5]) == {"n": [None]} and ranks.quantiles(df, [], [0.5]) == {}


@pytest.mark.parametrize("few, column", [(20, "spread"), (20, "ties"), (5000, "even"), (20, "close")])
def test_grouped_quantiles(shapes, few, column):
    got = {r.grp: r.q for r in ranks.grouped_quantiles(shapes, column, "g", PROBS, few).collect()}
    want = shapes.where(f"`{column}` is not null").groupBy("g").agg(F.percentile(column, F.array(*map(F.lit, PROBS))).alias("q")).collect()
    assert set(got) == {r.g for r in want}
    assert all(same(a, b) for r in want for a, b in zip(got[r.g], r.q))


def test_state_is_bounded(shapes):
    """No exact percentile and no mode buffer is left in the operators that use them."""
    for out in (features.describe(shapes, ["even"]), stats.distribution(shapes, ["even"]), stats.box_stats(shapes, "even", "g"), outliers.outlier_flag(shapes, "even")):
        assert not re.search(r"\b(percentile|mode)\(", out._jdf.queryExecution().toString().lower())


@pytest.mark.parametrize("counters, fullest", [(65_536, 32), (16, 2), (1, 1)])
def test_modes(spark, monkeypatch, counters, fullest):
    monkeypatch.setattr(ranks, "COUNTERS", counters)
    monkeypatch.setattr(ranks, "FULLEST", fullest)
    rng = random.Random(counters)
    rows = [(rng.randint(0, 3000), rng.choice("abc") if i % 5 else None, float(rng.randint(0, 40)), None, i, f"x{min(rng.randint(0, 400), rng.randint(0, 400))}") for i in range(4000)]
    df = spark.createDataFrame(rows, "wide int, `le.tters` string, num double, none string, key int, text string").repartition(3)
    got = ranks.modes(df, df.columns)
    for i, c in enumerate(df.columns):
        n = Counter(r[i] for r in rows if r[i] is not None)
        assert got[c] == (min(v for v in n if n[v] == max(n.values())) if n else None), c
    assert ranks.modes(df.limit(0), ["num"]) == {"num": None} and ranks.modes(df, []) == {}


def test_numbering(spark):
    values = [f"v{(i * 7919) % 5003:05d}" for i in range(5003)]
    df = spark.createDataFrame([(v, 1) for v in values], "value string, n int").repartition(6)
    for rows in (250_000, 400):
        got = ranks.numbered(df, "value", "label", rows)
        assert [(r.value, r.label) for r in got.orderBy("value").collect()] == [(v, i) for i, v in enumerate(sorted(values))]
    assert ranks.numbered(df.limit(0), "value").count() == 0
    plan = features.label_encode(df, "value")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_first_values(spark):
    rows = [(i, f"a{i}" if i % 3 else None, str(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, a string, `b.c` string").repartition(5)
    got = ranks.first_values(df, ["a", "b.c"], "k", 10)
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
    by = {0: [], 1: []}
    for r in got.collect():
        by[r.i].append(r.v)
    assert set(by[0]) == {f"a{i}" for i in range(15) if i % 3} and set(by[1]) == {str(i) for i in range(10)}
    assert clean.date_share(df, []) == {} and clean.date_share(df.limit(0), ["a"]) == {"a": 0.0}


def test_ordered_fill_with_a_frequent_order_value(spark):
    """Two thirds of the rows tie in the order, some have no order value: ranges stay small and fills exact."""
    rows = [(5, "T", i) for i in range(2000)] + [(i, None if i % 3 else f"v{i}", 10_000 + i) for i in range(6, 800)] + [(None, "N", 20_000 + i) for i in range(300)] + [(i, None, 30_000 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "o int, v string, k int").repartition(4)
    forward = {r.k: r.v for r in nulls.fill_forward(df, "v", "o", rows=100).collect()}
    backward = {r.k: r.v for r in nulls.fill_backward(df, "v", "o", rows=100).collect()}
    for o, v, k in rows:
        if o is None:
            assert forward[k] == backward[k] == "N"
        elif o < 5:
            assert forward[k] == "N" and backward[k] == "T"
        elif o == 5:
            assert forward[k] == backward[k] == "T"
        else:
            assert forward[k] == f"v{o - o % 3}" and backward[k] == (f"v{o + -o % 3}" if o + -o % 3 < 800 else None)
