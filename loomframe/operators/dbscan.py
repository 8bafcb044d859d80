"""DBSCAN by a grid whose cells need no pairs inside them.

A cell has side eps / sqrt(dimensions), so all its points are neighbours: one of ``min_samples`` points or more is core by
count. Only points of sparser cells are compared with their surroundings. Clusters are components of cells, and whether
two cells touch is settled on boxes: a box is the range of the points in it, two boxes are surely near, surely apart, or
both are cut in half and looked at again, until boxes are single places and the answer is exact.
"""

import itertools
import math

from pyspark.sql import functions as F

from ..functions.expr import col_of
from ..functions.work import Scratch
from .ranks import numbered


def _distance(a, b):
    d = F.lit(0.0)
    for x, y in zip(a, b):
        d = d + (x - y) * (x - y)
    return d


def _gap(lo_a, hi_a, lo_b, hi_b):
    """Squared least distance of two boxes; of two places, their distance by the same formula as for points."""
    zero = F.lit(0.0)
    return _distance([F.greatest(b - c, d - a, zero) for a, b, c, d in zip(hi_a, lo_a, hi_b, lo_b)], [zero] * len(lo_a))


def _reach(lo_a, hi_a, lo_b, hi_b):
    """Squared greatest distance of two boxes."""
    return _distance([F.greatest(b - c, d - a) for a, b, c, d in zip(lo_a, hi_a, lo_b, hi_b)], [F.lit(0.0)] * len(lo_a))


#: Pairs of points of two boxes that are compared one by one.
FEW_PAIRS = 4096


def _touching(work, core, dims, eps2):
    """(a, b), a < b: pairs of cells with core points within reach of each other.

    ``core``: cell, g0.. (coarse cell), x0.. (place). Candidates are cells of neighbouring coarse cells. Two boxes that are neither surely
    near nor surely apart are settled by their points if those make at most FEW_PAIRS pairs; larger ones are halved.
    """
    xs, k = [f"x{i}" for i in range(dims)], min(dims, 3)
    lows, highs = [f"lo{i}" for i in range(dims)], [f"hi{i}" for i in range(dims)]
    box = [F.count("*").alias("n"), *[f(x).alias(f"{n}{i}") for i, x in enumerate(xs) for f, n in ((F.min, "lo"), (F.max, "hi"))]]
    side = lambda p: [[F.col(f"{p}{n}") for n in names] for names in (lows, highs)]
    named = lambda t, p: t.select(*[F.col(c).alias(p + c) for c in t.columns])
    ids = ["a_cell", "b_cell", "a_box", "b_box"]
    told = lambda met: work.write(met.where(_gap(*side("a_"), *side("b_")) <= eps2).select(*ids, "a_n", "b_n", (_reach(*side("a_"), *side("b_")) <= eps2).alias("sure")))

    points = core.select("cell", *xs, F.lit(0).cast("long").alias("box"))
    cells = work.write(core.groupBy("cell", *[f"g{i}" for i in range(k)]).agg(*box).withColumn("box", F.lit(0).cast("long")))
    shifts = F.array(*[F.struct(*[F.lit(s).cast("long").alias(f"s{i}") for i, s in enumerate(o)]) for o in itertools.product((-1, 0, 1), repeat=k)])
    a, b = named(cells.withColumn("s", F.explode(shifts)), "a_"), named(cells, "b_")
    on = [F.col(f"a_g{i}") + F.col(f"a_s.s{i}") == F.col(f"b_g{i}") for i in range(k)]
    met, sure, level = told(a.join(b, on).where(F.col("a_cell") < F.col("b_cell"))), None, 0
    while True:
        open_, few = met.where("not sure"), F.col("a_n") * F.col("b_n") <= FEW_PAIRS
        pair = open_.where(few).join(named(points, "a_"), ["a_cell", "a_box"]).join(named(points, "b_"), ["b_cell", "b_box"])
        close = pair.where(_distance([F.col(f"a_{x}") for x in xs], [F.col(f"b_{x}") for x in xs]) <= eps2)
        found = work.write(met.where("sure").select("a_cell", "b_cell").union(close.select("a_cell", "b_cell")).distinct())
        sure = found if sure is None else sure.union(found)
        sub = work.write(open_.where(~few).join(found, ["a_cell", "b_cell"], "left_anti").select(*ids))
        if not sub.limit(1).count():
            return sure.select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b")).distinct()
        level += 1
        live = sub.select(F.col("a_cell").alias("cell"), F.col("a_box").alias("box")).union(sub.select("b_cell", "b_box")).distinct()
        held = points.join(live, ["cell", "box"], "left_semi")
        half_way = lambda x: F.when((F.min(x) + F.max(x)) / 2 < F.max(x), (F.min(x) + F.max(x)) / 2).otherwise(F.min(x))
        middle = held.groupBy("cell", "box").agg(*[half_way(x).alias(f"m{i}") for i, x in enumerate(xs)])
        half = F.lit(0).cast("long")
        for i, x in enumerate(xs):
            half = half * 2 + F.when(F.col(x) > F.col(f"m{i}"), 1).otherwise(0)
        # a box is named by the hash of its path, so depth has no limit
        deeper = work.write(held.join(middle, ["cell", "box"]).select("cell", *xs, F.col("box").alias("old"), F.xxhash64("box", F.lit(level), half).alias("box")))
        boxes, points = work.write(deeper.groupBy("cell", "old", "box").agg(*box)), deeper.drop("old")
        of = lambda p: named(boxes, p).withColumnsRenamed({f"{p}box": f"{p}new", f"{p}old": f"{p}box"})
        met = sub.join(of("a_"), ["a_cell", "a_box"]).join(of("b_"), ["b_cell", "b_box"])
        met = told(met.drop("a_box", "b_box").withColumnsRenamed({"a_new": "a_box", "b_new": "b_box"}))


def _components(work, nodes, links, rounds):
    """(cell, label): the smallest ``label`` among all cells linked to each. In a round, all cells of one label move together
    to the smallest label next to any of them, and on to the label to which that one moves."""
    both = work.write(links.union(links.select("b", "a")).toDF("cell", "other"))
    labels = work.write(nodes)
    for _ in range(rounds):
        beside = both.join(labels.select(F.col("cell").alias("other"), F.col("label").alias("l")), "other").groupBy("cell").agg(F.min("l").alias("m"))
        low = labels.join(beside, "cell", "left").groupBy("label").agg(F.min(F.least("label", F.coalesce("m", "label"))).alias("to"))
        hook = work.write(low)
        if not hook.where("label <> to").limit(1).count():
            return labels
        moved = hook.join(hook.select(F.col("label").alias("to"), F.col("to").alias("up")), "to").select("label", "up")
        labels = work.write(labels.join(moved, "label").select("cell", F.col("up").alias("label")))
    raise RuntimeError(f"clusters did not settle in {rounds} rounds")


def dbscan(df, key, features, eps, min_samples, rounds=100):
    """(key, cluster): clusters numbered 0.. by their smallest core member, noise -1. Rows with a null feature are left
    out; so are NaN and infinite ones.

    Keys must be unique. A point counts as its own neighbour, a distance of exactly eps as near. A border point near several clusters joins the
    one with the smallest number. Cells are met by up to three features; with more of them, cells far apart in the
    others are met and dropped.
    """
    dims, k, work = len(features), min(len(features), 3), Scratch(df.sparkSession, "dbscan")
    eps2, xs = eps * eps, [f"x{i}" for i in range(dims)]
    xs_of = [col_of(f).cast("double") for f in features]
    pts = df.dropna(subset=list(features)).select(col_of(key).alias("id"), *[x.alias(n) for x, n in zip(xs_of, xs)])
    for x in xs:
        pts = pts.where(F.abs(F.col(x)) < float("inf"))
    side = eps / math.sqrt(dims) * (1 - 1e-9)  # a hair smaller, so that rounding can't part two points of a cell
    fine = [F.floor(F.col(x) / side) for x in xs]
    pts = work.write(pts.select("*", F.concat_ws(",", *fine).alias("cell"), *[F.floor(F.col(x) / eps).alias(f"g{i}") for i, x in enumerate(xs[:k])]))
    sizes = work.write(pts.groupBy("cell").agg(F.count("*").alias("size")))
    sparse = pts.join(sizes.where(F.col("size") < min_samples).select("cell"), "cell", "left_semi")

    # neighbours of the points in sparse cells: places of neighbouring coarse cells, repeated ones counted once
    shifts = F.array(*[F.struct(*[F.lit(s).cast("long").alias(f"s{i}") for i, s in enumerate(o)]) for o in itertools.product((-1, 0, 1), repeat=k)])

    def near(rows, others, *more):
        left = rows.select("id", *xs, *[f"g{i}" for i in range(k)], F.explode(shifts).alias("s")).select("id", *xs, *[(F.col(f"g{i}") + F.col(f"s.s{i}")).alias(f"g{i}") for i in range(k)])
        right = others.select(*[F.col(x).alias(x.replace("x", "y")) for x in xs], *[f"g{i}" for i in range(k)], *more)
        return left.join(right, [f"g{i}" for i in range(k)]).where(_distance([F.col(x) for x in xs], [F.col(x.replace("x", "y")) for x in xs]) <= eps2)

    places = pts.groupBy(*xs, *[f"g{i}" for i in range(k)]).agg(F.count("*").alias("times"))
    counted = near(sparse, places, "times").groupBy("id").agg(F.sum("times").alias("n")).where(F.col("n") >= min_samples).select("id")
    dense = pts.join(sizes.where(F.col("size") >= min_samples).select("cell"), "cell", "left_semi").select("id")
    core_ids = work.write(dense.union(counted))
    core = work.write(pts.join(core_ids, "id", "left_semi"))
    links = _touching(work, core, dims, eps2)
    labels = _components(work, core.groupBy("cell").agg(F.min("id").alias("label")), links, rounds)
    named = work.write(numbered(labels.select("label").distinct(), "label", "cluster"))
    cells = work.write(labels.join(named, "label").select("cell", "cluster"))
    inside = core.select("id", "cell").join(cells, "cell").select("id", "cluster")
    rim = sparse.join(core_ids, "id", "left_anti")
    placed = core.join(cells, "cell").groupBy(*xs, *[f"g{i}" for i in range(k)]).agg(F.min("cluster").alias("cluster"))
    border = near(rim, placed, "cluster").groupBy("id").agg(F.min("cluster").alias("cluster"))
    out = pts.select("id").join(inside.unionByName(border), "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
