"""Importance resampling toward a target distribution: array-scored weights, Gumbel keys, parallel sorting by regular sampling.

Every run of ``lo`` to ``hi`` words falls into one of a fixed number of buckets. Two counted histograms, of the documents
and of the target, give a whole-number gain a bucket; a document's weight is the sum over its runs, read from an array
of fixed size that all tasks hold. Weight plus Gumbel noise (a hash of the key) orders the documents; the highest are a
sample without replacement in proportion to the weights.

The order is made by regular sampling: every task writes its scored rows as a sorted run, each run gives every g-th row as a
sample, splitters are taken at regular places of the sorted samples, rows are exchanged by segment and sorted there, and
the segments' counts, summed up, turn a row's place in its segment into its exact rank. Segments beyond the draw are
counted and not sorted.
"""

import bisect
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .storage import stage

BUCKETS = 10_000
#: Samples of all runs together, about; segments at most; rows of a segment, about.
SAMPLES, SEGMENTS, SEGMENT_ROWS = 65_536, 4096, 100_000
#: Characters whose words a task holds at once when it counts.
GROUP = 1 << 20

#: A-Z lower-cased, digits, a-z and all bytes beyond ASCII as they are, everything else a blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text):
    """Words (as UTF-8) of a text: runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(_WORD_BYTES).split()


def runs(found, lo, hi):
    """All runs of lo to hi consecutive words, joined by a blank."""
    out = []
    for n in range(lo, hi + 1):
        out += found if n == 1 else [b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)]
    return out


def buckets_of(features, buckets):
    return np.fromiter(map(zlib.crc32, features), np.int64, len(features)) % buckets


def histogram(docs, text="text", lo=1, hi=1, buckets=BUCKETS):
    """Occurrences of each bucket over all whole texts, as an array; what reaches the driver is a row a bucket."""

    def count(batches):
        total, held, size = np.zeros(buckets, np.int64), [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                held += runs(words(t), lo, hi)
                size += len(t)
                if size >= GROUP:
                    total += np.bincount(buckets_of(held, buckets), minlength=buckets)
                    held, size = [], 0
        total += np.bincount(buckets_of(held, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = docs.select(F.col(text).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def gains(target, corpus):
    """1000 times the log ratio of the smoothed shares of each bucket, rounded down."""
    s, t, k = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + k) / (float(a + 1) * float(t + k)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(key, seed):
    """Gumbel noise times 1000, rounded down, from the hash of seed and key (a null key: of the seed alone)."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs, gain, key="doc_id", text="text", lo=1, hi=1, seed=2024):
    """(key, n_words, n_features, weight, score) a row of ``docs``; null and empty texts have no features and weight 0."""
    kind, sent = docs.select(key).schema[0].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = sent.value
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(t or "")
                f = runs(w, lo, hi)
                weight = int(gain[buckets_of(f, len(gain))].sum())
                out.append((len(w), len(f), weight, weight + noise(k, seed)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 4))], ["key", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long, score long")


_ORDER = (F.desc, F.asc_nulls_last, F.asc)


def _order(names=("score", "key", "u")):
    return [f(n) for f, n in zip(_ORDER, names)]


def _plain(score, key, u):
    return -score, key is None, key if key is not None else 0, u


def splitters(sorted_runs, rows, segments, samples=SAMPLES):
    """Bounds between segments, as order tuples: regular places of the regular samples of all runs."""
    gap = max(1, rows // samples)

    def pick(batches):
        seen = 0
        for b in batches:
            at = np.arange((gap // 2 - seen) % gap, b.num_rows, gap)
            seen += b.num_rows
            yield b.take(pa.array(at))

    cols = sorted_runs.select("score", "key", "u")
    drawn = sorted(_plain(*r) for r in cols.mapInArrow(pick, cols.schema).collect())  # rows / gap of them, under twice ``samples``
    if not drawn:
        return []
    return sorted({drawn[len(drawn) * i // segments] for i in range(1, segments)})


def _segment(bounds, schema):
    scores = np.array([-b[0] for b in bounds], np.int64)

    def run(batches):
        for b in batches:
            s = b.column("score").to_numpy()
            lo, hi = np.searchsorted(-scores, -s, "left"), np.searchsorted(-scores, -s, "right")
            seg = lo.astype(np.int32)
            for i in np.flatnonzero(lo != hi).tolist():  # as high as a bound: told apart by key
                seg[i] = bisect.bisect_right(bounds, _plain(int(s[i]), b.column("key")[i].as_py(), b.column("u")[i].as_py()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seg)], [*b.schema.names, "segment"])

    return run, f"{schema}, segment int"


def ranked(rows, most, total=None, segments=None, samples=SAMPLES):
    """``rows`` (score long, key, ...) plus ``rank``: 1, 2, 3 ... by falling score, ties to the smaller key, down to
    ``most``; null beyond. Nulls come last among tied keys; rows alike in both get different ranks, in any order.

    ``rows`` must not have columns named u, segment or rank.
    """
    spark = rows.sparkSession
    held = stage(rows.withColumn("u", F.monotonically_increasing_id()).sortWithinPartitions(*_order()), "runs")
    total = held.count() if total is None else total
    segments = segments or max(1, min(SEGMENTS, total // 16, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SEGMENT_ROWS))))
    bounds = splitters(held, total, segments, samples)
    run, ddl = _segment(bounds, ", ".join(f"`{n}` {k}" for n, k in held.dtypes))
    dealt = stage(held.mapInArrow(run, ddl), "segments")
    counts = {r[0]: r[1] for r in dealt.groupBy("segment").agg(F.count("*")).collect()}  # at most ``segments`` rows
    first, before = [], 0
    for i in range(len(bounds) + 1):
        first.append(before)
        before += counts.get(i, 0)
    reach = sum(f < most for f in first)  # segments that hold a drawn row
    place = F.row_number().over(Window.partitionBy("segment").orderBy(*_order()))
    rank = (F.get(F.array(*[F.lit(f) for f in first[:reach]] or [F.lit(0)]), F.col("segment")) + place).cast("long")
    near = dealt.where(F.col("segment") < reach).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return near.unionByName(dealt.where(F.col("segment") >= reach).withColumn("rank", F.lit(None).cast("long"))).drop("u", "segment")


def resample(docs, target, key="doc_id", text="text", percent=10, least_words=20, lo=1, hi=1, buckets=BUCKETS, seed=2024, target_text="text"):
    """One row a row of ``docs``: key, n_features, weight, score, rank. Of the documents with ``least_words`` words or
    more, ``percent`` percent (rounded down) are drawn and ranked from 1; the others have a null rank.

    Null texts have no words; repeated rows take part each; other columns take no part. An empty target gives weights
    all the same sign of rarity, an empty ``docs`` no rows.
    """
    gain = gains(histogram(target, target_text, lo, hi, buckets), histogram(docs, text, lo, hi, buckets))
    base = stage(scored(docs, gain, key, text, lo, hi, seed), "scored")
    fit = F.col("n_words") >= least_words
    n = base.where(fit).count()
    out = ranked(base.where(fit), percent * n // 100, n).unionByName(base.where(~fit).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("key").alias(key), "n_features", "weight", "score", "rank")


def draw(docs, target, key="doc_id", **settings):
    """The drawn rows of ``docs``, all columns; keys must be unique."""
    return docs.join(resample(docs, target, key, **settings).where("rank is not null").select(key), key, "left_semi")


def op13_resample(spark, sf_dir):
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
