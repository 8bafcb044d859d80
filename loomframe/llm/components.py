"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum (combined before the shuffle) and an equality join (which adaptive execution can
split where a hub has many edges); each round's edges are written and reread.
"""

from pyspark.sql import functions as F

from .storage import dropped, stage


def components(edges, a="a", b="b", max_rounds=50):
    """(id, root): for every id on an edge between two different ids, the smallest id reachable from it.

    Null ends and self-loops are ignored; repeated and reversed edges count once. An empty table gives an empty one.
    Ids may be of any type that Spark can order.
    """
    e = stage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return e.select(F.col("v").alias("id"), F.col("u").alias("root")).union(e.select(F.col("u"), F.col("u"))).distinct()
        before = now
        both = e.select(F.col("v").alias("n"), F.col("u").alias("m")).union(e.select(F.col("u"), F.col("v")))
        low = both.groupBy("n").agg(F.min("m").alias("lo")).select("n", F.least("n", "lo").alias("lo"))
        large = both.where("m > n").join(low, "n").select(F.col("m").alias("v"), F.col("lo").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("lo"))
        pairs = F.array(F.struct(F.col("v").alias("v"), F.col("lo").alias("u")), F.struct(F.col("u").alias("v"), F.col("lo").alias("u")))
        smaller = stage(large.join(low, "v").select(F.explode(pairs).alias("p")).select("p.v", "p.u").where("v <> u").distinct(), "edges")
        dropped(e)
        e = smaller
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
