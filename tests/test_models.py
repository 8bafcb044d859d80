"""The kernel machine, the exact neighbour search and the stratified split against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomframe.operators import ml


def rings(spark, n, classes=2):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        c, a = i % classes, rng.random() * 2 * math.pi
        r = (1 + 2 * c) * 100 + rng.gauss(0, 25)
        rows.append((i, r * math.cos(a), r * math.sin(a), float(c)))
    return ml.prepare(spark.createDataFrame(rows, "k int, x double, y double, c double"), ["x", "y"], "c", ("k",))


@pytest.mark.parametrize("classes", [2, 3])
def test_svm_tells_rings_apart(spark, classes):
    data = rings(spark, 600, classes)
    train, test = data.where("k % 5 > 0"), data.where("k % 5 = 0")
    model = ml.classifier("svm").fit(train)
    out = model.transform(test)
    assert ml.accuracy(out).first()[0] > 0.93
    p = out.agg(F.max(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x) - 1)).alias("off"), F.min(F.size("probability")).alias("n"), F.min(F.array_min("probability")).alias("low")).first()
    assert p["off"] < 1e-9 and p["n"] == classes and p["low"] >= 0
    sure = out.where(F.array_max("probability") > 0.9)
    assert ml.accuracy(sure).first()[0] >= ml.accuracy(out).first()[0]
    flat = ml.classifier("logreg").fit(train).transform(test)  # no line can
    assert ml.accuracy(flat).first()[0] < 0.75


def test_svm_probabilities_are_calibrated(spark):
    """A label that is right for 80 % of the rows: the mean probability of the predicted class is near that."""
    rng = random.Random(3)
    rows = [(i, (x := rng.gauss(0, 1)), rng.gauss(0, 1), float((x > 0) == (rng.random() < 0.8))) for i in range(1500)]
    data = ml.prepare(spark.createDataFrame(rows, "k int, x double, y double, c double"), ["x", "y"], "c", ("k",))
    out = ml.RbfSvm().fit(data).transform(data)
    assert abs(out.agg(F.avg(F.array_max("probability"))).first()[0] - 0.8) < 0.08
    with pytest.raises(ValueError):
        ml.RbfSvm().fit(data.where("label = 1"))


def test_gbt_learns_from_bins(spark, monkeypatch):
    """A round costs the combinations of bins, not the rows; with few values the trees are MLlib's own on all rows."""
    from pyspark.ml.classification import GBTClassifier

    rng = random.Random(5)
    rows = [(i, (x := float(rng.randint(0, 9))), (y := rng.randint(0, 6) / 3), 1.0, float(x * (1 + y) + rng.gauss(0, 2) > 9)) for i in range(3000)]
    data = ml.prepare(spark.createDataFrame(rows, "k int, x double, y double, z double, c double"), ["x", "y", "z"], "c", ("k",))
    plain = GBTClassifier(maxIter=5, seed=42).fit(data)
    fit, seen = GBTClassifier.fit, []
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df, *a: seen.append(df.count()) or fit(self, df, *a))
    model = ml.classifier("gbt", rounds=5).fit(data)
    assert seen and seen[0] <= 2 * 10 * 7
    some = ml.prepare(spark.createDataFrame([(i, i / 7 - 1, i % 10 / 4, float(i % 3)) for i in range(90)], "k int, x double, y double, z double"), ["x", "y", "z"], None, ("k",)).union(data.select("k", "features"))
    out = model.transform(some)
    assert out.columns == plain.transform(some).columns
    got, want = ([(r.k, r.prediction, r.probability[1]) for r in m.transform(some).collect()] for m in (model, plain))
    bad = [(g, w) for g, w in zip(got, want) if g[:2] != w[:2] or abs(g[2] - w[2]) > 1e-9]
    assert not bad, (len(bad), bad[:5])
    steps = spark.range(4000).select("id", (F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 7).alias("y")).withColumn("c", (F.col("x") + F.col("y") > 30).cast("double"))
    steps = ml.prepare(steps, ["x", "y"], "c", ("id",))  # 50 values, 32 bins
    got, want = ([r.prediction for r in m.fit(steps).transform(steps).orderBy("id").collect()] for m in (ml.classifier("gbt", rounds=3), GBTClassifier(maxIter=3, seed=42)))
    assert got == want
    monkeypatch.setattr(ml, "VALUES", 100)
    spread = rings(spark, 600)  # more values than are counted
    model = ml.classifier("gbt", rounds=10).fit(spread)
    assert ml.accuracy(model.transform(spread)).first()[0] > 0.93 and max(map(len, model.cuts)) == 31
    with pytest.raises(ValueError):
        ml.classifier("gbt").fit(spread.limit(0))


@pytest.mark.parametrize("kind", ["spread", "ties", "one place", "few"])
def test_knn_is_brute_force(spark, kind):
    rng = random.Random(kind)
    n = 4 if kind == "few" else 500
    place = {"spread": lambda: [rng.gauss(0, 1) + 8 * (rng.random() < 0.3) for _ in range(3)], "ties": lambda: [float(rng.randint(0, 3)) for _ in range(2)], "one place": lambda: [1.5, 2.5], "few": lambda: [rng.random()]}[kind]
    rows = [(i, place(), i % 3) for i in range(n)] + [(10_000, None, 1)]
    df = spark.createDataFrame(rows, "k int, v array<double>, y int").repartition(4)
    out = ml.knn(df.where("k % 10 = 0"), df, "v", "k", "y", 5)
    assert "Cartesian" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()
    got = sorted((r.k, r.rank, r.neighbour, r.label) for r in out.collect())
    want = []
    for k, v, _ in rows[:-1]:
        if k % 10 == 0:
            near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j, y) for j, w, y in rows[:-1] if j != k)
            want += [(k, r, j, y) for r, (_, j, y) in enumerate(near[:5], 1)]
    assert got == want
    assert ml.knn(df, df.limit(0), "v", "k", "y").count() == 0


@pytest.mark.parametrize("kind", ["spread", "one place", "far off"])
def test_knn_in_many_blocks(spark, kind, monkeypatch):
    """Training rows of one pivot in several blocks, test rows dealt over several, text keys; sums as told term by term."""
    monkeypatch.setattr(ml, "BLOCK", 1)
    monkeypatch.setattr(ml, "QUERY_BLOCK", 16)
    rng = random.Random(kind)
    place = {"spread": lambda: [rng.gauss(0, 1) for _ in range(6)], "one place": lambda: [0.1, 0.7], "far off": lambda: [1e6 + rng.random() / 1000, 3.0]}[kind]
    rows = [(f"k{i}", place(), i % 3 or None) for i in range(900)] + [(None, place(), 1)]
    df = spark.createDataFrame(rows, "k string, v array<double>, y int").repartition(4)

    def apart(v, w):
        d = 0.0
        for a, b in zip(v, w):
            d += (a - b) * (a - b)
        return d

    got = sorted((r.k, r.rank, r.neighbour, r.label, r.distance) for r in ml.knn(df.where("k like '%0'"), df, "v", "k", "y", 4).collect())
    want = []
    for k, v, _ in rows[:-1]:
        if k[-1] == "0":
            near = sorted((apart(v, w), j, y or 0) for j, w, y in rows[:-1] if j != k)
            want += [(k, r, j, y or None, d) for r, (d, j, y) in enumerate(near[:4], 1)]
    assert got == sorted(want)


def test_split_is_exact_and_stable(spark):
    rows = [(i, "a" if i % 3 else None if i % 2 else "b") for i in range(5000)] + [(9001, "alone")]
    df = spark.createDataFrame(rows, "k int, y string").repartition(5)
    for share in (0.0, 0.2, 0.37, 1.0):
        got = ml.split_stratified(df, "k", "y", share)
        assert got.columns == ["k", "y", "is_test"]
        first = got.collect()
        assert Counter(r.k for r in first) == Counter(k for k, _ in rows)
        per = Counter((r.y, r.is_test) for r in first)
        for y, n in Counter(y for _, y in rows).items():
            assert per[y, True] == math.floor(n * share + 0.5)
        assert {(r.k, r.is_test) for r in first} == {(r.k, r.is_test) for r in ml.split_stratified(df.repartition(2), "k", "y", share).collect()}
    order = {r.k: r.h for r in df.select("k", F.xxhash64(F.lit(42), "k").alias("h")).collect()}
    inside = [order[r.k] for r in ml.split_stratified(df, "k", "y", 0.2).where("is_test and y = 'a'").collect()]
    outside = [order[r.k] for r in ml.split_stratified(df, "k", "y", 0.2).where("not is_test and y = 'a'").collect()]
    assert max(inside) < min(outside)
