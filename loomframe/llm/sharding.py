"""Sharding by sampled splitters: shards of near equal bytes.

A size-weighted sample of keys (hash of the text) gives quantile boundaries of many narrow ranges; every record falls in
one range, ranges that turn out overfull are subdivided, and ranges are dealt to shards by their exact sizes. Texts so
frequent that one of them fills a range are ranges of their own, subdivided by a second hash. Equal texts stay in one
shard unless they alone are larger than a shard. The texts themselves are not shuffled to decide this.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .storage import fresh, smallest, stage

RANGES = 1024
SAMPLE = 16_384
#: Added to a record's bytes where ranges are balanced: records cost something however short.
RECORD = 64


def _prepared(docs, key, text):
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("key"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("k"),
        F.xxhash64(F.lit("within"), F.col(key).cast("string"), F.monotonically_increasing_id()).alias("k2"),
    )


def splitters(base, ranges=RANGES, sample=SAMPLE):
    """(hot keys, cold boundaries) from a sample of at most ``sample`` records, drawn in proportion to their weight."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "k", "k2"), 11) + 1) / F.lit(float(2**53 + 1))
    n, weight = base.agg(F.count("*"), F.sum(F.col("size") + RECORD)).first()
    low = F.col("order") < 1.2 * sample / (weight or 1) + 1e-300  # of which so many are expected, a little fewer with heavy records
    keyed = base.select("k", (-F.log(u) / (F.col("size") + RECORD)).alias("order"))
    drawn = smallest(keyed, [F.col("order")], low, sample, n)["k"].to_numpy()
    if not len(drawn):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, n = np.unique(drawn, return_counts=True)
    hot = k[n >= max(2.0, len(drawn) / ranges * 2)]
    cold = np.sort(drawn[~np.isin(drawn, hot)])
    cuts = cold[np.linspace(0, len(cold), min(ranges, max(1, len(cold) // 4)) + 1)[1:-1].astype(int)] if len(cold) else cold
    return hot, np.unique(cuts)


def _range_of(hot, cuts):
    def run(batches):
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            r = np.searchsorted(cuts, k, "right").astype(np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, k), len(hot) - 1)
                r = np.where(hot[at] == k, -1 - at, r)  # negative: a range of one hot text
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r)], [*b.schema.names, "r"])

    return run


def deal(pieces, hot_bytes, shards):
    """(r, sub) -> (shard, first slot), from exact [(r, sub, bytes, rows)].

    Hot texts that fit a shard go whole to the emptiest; others are filled in piece by piece; then cold ranges, in key
    order, fill up what is left of each shard.
    """
    total = sum(p[2] for p in pieces)
    goal = total / shards
    load, where = [0.0] * shards, {}
    by_hot = {}
    for p in pieces:
        if p[0] < 0:
            by_hot.setdefault(p[0], []).append(p)
    for r in sorted(by_hot, key=lambda r: (-hot_bytes[r], r)):
        low = min(range(shards), key=lambda s: (load[s], s))
        if load[low] + hot_bytes[r] <= goal * 1.001:
            for p in by_hot[r]:
                where[p[:2]] = low
            load[low] += hot_bytes[r]
        else:
            for p in sorted(by_hot[r]):
                low = min(range(shards), key=lambda s: (load[s], s))
                where[p[:2]] = low
                load[low] += p[2]
    s = 0
    for p in sorted(p for p in pieces if p[0] >= 0):
        while s < shards - 1 and load[s] + p[2] / 2 > goal:
            s += 1
        where[p[:2]] = s
        load[s] += p[2]
    slots, out = [0] * shards, {}
    for p in sorted(pieces):
        out[p[:2]] = (where[p[:2]], slots[where[p[:2]]])
        slots[where[p[:2]]] += p[3]
    return out


def assign(docs, key="doc_id", text="text", shards=8, ranges=RANGES, sample=SAMPLE):
    """One row a record: key, size (bytes of the text plus 1), text_crc32, shard, slot (gapless from 0 in its shard).

    A null text counts as empty; null keys and repeated rows are records like any other; other columns take no part.
    An empty table gives no rows.
    """
    base = stage(_prepared(docs, key, text), "records")
    hot, cuts = splitters(base, ranges, sample)
    kinds = base.dtypes
    tagged = base.select("k", "size", "k2", "key", "text_crc32").mapInArrow(_range_of(hot, cuts), "k long, size long, k2 long, key " + dict(kinds)["key"] + ", text_crc32 long, r long")
    weight = F.sum(F.col("size") + RECORD)
    sums = [tuple(r) for r in tagged.groupBy("r").agg(weight, F.sum("size"), F.min("k"), F.max("k")).collect()]  # at most ranges + hot texts rows
    full = sum(r[1] for r in sums) / max(1, ranges)
    parts = {r[0]: min(ranges, math.ceil(r[1] / full)) for r in sums if r[1] > 2 * full}
    bounds = {r[0]: (r[3], r[4]) for r in sums}
    sub = F.lit(0)
    if parts:
        unit = lambda h: F.shiftrightunsigned(h, 11) / F.lit(float(2**53))
        table = F.broadcast(docs.sparkSession.createDataFrame([(r, n, float(bounds[r][0]), float(bounds[r][1]) - float(bounds[r][0]) + 1.0) for r, n in parts.items()], "r long, parts int, low double, width double"))
        tagged = tagged.join(table, "r", "left")
        inside = F.when(F.col("r") < 0, unit(F.col("k2"))).otherwise((F.col("k").cast("double") - F.col("low")) / F.col("width"))
        sub = F.coalesce(F.least(F.floor(inside * F.col("parts")), F.col("parts") - 1), F.lit(0))
    tagged = tagged.withColumn("sub", sub.cast("int")).select("key", "size", "text_crc32", "k", "k2", "r", "sub")
    pieces = [tuple(r) for r in tagged.groupBy("r", "sub").agg(F.sum("size"), F.count("*")).collect()]
    if not pieces:
        return tagged.select(F.col("key").alias(key), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    dealt = deal(pieces, {r[0]: r[2] for r in sums}, shards)
    table = F.broadcast(docs.sparkSession.createDataFrame([(r, s, x, n) for (r, s), (x, n) in dealt.items()], "r long, sub int, shard int, first long"))
    at = F.row_number().over(Window.partitionBy("r", "sub").orderBy("k", "k2")) - 1
    return tagged.withColumn("at", at).join(table, ["r", "sub"]).select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("first") + F.col("at")).alias("slot"))


def write_shards(docs, path, key="doc_id", text="text", shards=8):
    """Write ``docs`` (all columns) as Parquet folders shard=0 .. shards-1 under ``path``; keys must be unique."""
    where = assign(docs, key, text, shards)
    shard = fresh("shard", docs.columns)
    out = docs.join(where.select(F.col(key), F.col("shard").alias(shard)), key)
    out.repartition(F.col(shard), F.pmod(F.xxhash64(key), F.lit(32))).write.partitionBy(shard).parquet(path)


def op9_sharding(spark, sf_dir):
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
