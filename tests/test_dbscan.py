"""DBSCAN against a plain neighbour search: dense cells, touching and almost touching clusters, ties, more dimensions."""

import random

import pytest
from pyspark.sql import functions as F

from loomframe.operators import dbscan


def brute(points, eps, least):
    """{id: cluster} by the definition; clusters numbered by their smallest core member."""
    near = {i: [j for j, q in points.items() if sum((a - b) * (a - b) for a, b in zip(p, q)) <= eps * eps] for i, p in points.items()}
    core = {i for i in points if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            todo = [i]
            label[i] = i
            while todo:
                for j in near[todo.pop()]:
                    if j in core and j not in label:
                        label[j] = i
                        todo.append(j)
    number = {c: n for n, c in enumerate(sorted(set(label.values())))}
    out = {i: number[c] for i, c in label.items()}
    for i in points:
        if i not in out:
            out[i] = min((out[j] for j in near[i] if j in core), default=-1)
    return out


def two_blobs(rng, gap):
    return [(rng.random() * 0.4, rng.random() * 0.4) for _ in range(150)] + [(0.4 + gap + rng.random() * 0.4, rng.random() * 0.4) for _ in range(150)]


CASES = {
    "random": lambda r: ([(r.random() * 8, r.random() * 8) for _ in range(300)], 0.5, 4),
    "dense, touching": lambda r: (two_blobs(r, 0.97), 1.0, 5),
    "dense, apart": lambda r: (two_blobs(r, 1.001), 1.0, 5),
    "exactly eps": lambda r: ([(float(i), 0.0) for i in range(30)] + [(float(i), 2.0) for i in range(30)], 1.0, 3),
    "repeated places": lambda r: ([(r.choice([0.0, 1.0, 5.0]), 0.0) for _ in range(200)], 1.0, 3),
    "one dimension": lambda r: ([(r.random() * 30,) for _ in range(200)], 0.2, 3),
    "five dimensions": lambda r: ([tuple(r.choice([0, 3]) + r.random() for _ in range(5)) for _ in range(200)], 0.9, 4),
    "adjacent numbers": lambda r: ([(1.0 + i * 2.0**-52, 0.0) for i in range(40)] + [(1.0, 2.0**-40)], 2.0**-50, 3),
}


@pytest.mark.parametrize("pairs", [4096, 1])
@pytest.mark.parametrize("case", list(CASES))
def test_dbscan(spark, monkeypatch, case, pairs):
    if pairs == 1 and case in ("random", "one dimension"):
        pytest.skip("many small boxes, as in the other cases")
    monkeypatch.setattr(dbscan, "FEW_PAIRS", pairs)
    points, eps, least = CASES[case](random.Random(case))
    ids = list(range(len(points)))
    random.Random(1).shuffle(ids)
    names = [f"f{i}" for i in range(len(points[0]))]
    rows = [(i, *p) for i, p in zip(ids, points)]
    df = spark.createDataFrame([*rows, (9999, *[None] * len(names))], "k long, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {r.k: r.cluster for r in dbscan.dbscan(df, "k", names, eps, least).collect()}
    assert got == brute({i: tuple(p) for i, *p in rows}, eps, least)


def test_dense_cell_is_linear(spark):
    """20,000 points of one cell, and as many of another next to it: no pairs of them are made."""
    df = spark.range(40_000).select("id", (F.rand(1) * 0.5 + F.when(F.col("id") % 2 == 0, 0.0).otherwise(0.6)).alias("x"), (F.rand(2) * 0.5).alias("y"))
    got = dbscan.dbscan(df, "id", ["x", "y"], 1.0, 10)
    assert got.groupBy("cluster").agg(F.count("*").alias("n")).collect() == [(0, 40_000)]


def test_empty(spark):
    assert dbscan.dbscan(spark.createDataFrame([], "k long, x double"), "k", ["x"], 1.0, 2).count() == 0
