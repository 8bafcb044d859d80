"""Toxicity by FTRL-proximal logistic regression (McMahan et al., 2013) over hashed word n-grams and skip-grams.

Features of a text (each present or not): its words, the words' stems (first four and five letters), word pairs, and
pairs with one word between. Each is hashed to one of 2 ** 20 coordinates. Every coordinate has its own learning rate,
and the L1 term leaves most weights at exactly zero, so the model is a short list of (coordinate, weight) that any
executor can hold, whatever the corpus.

Training reads at most ``max_rows`` labelled documents (a bounded sample, the documented parameter), chosen by hash of
their key; scoring reads every document whole.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .storage import fresh, stage

BITS = 20
MAX_ROWS = 12_000
_WORD = re.compile(r"[^\W_]+").findall
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Features:
    """Coordinates of texts; remembers the hashes of words it has seen (a bounded number)."""

    def __init__(self, bits=BITS, remembered=500_000):
        self.shift, self.most = np.uint64(64 - bits), remembered
        self.forget()

    def forget(self):
        self.ids, self.table, self.n = {}, np.zeros((1024, 3), np.uint64), 0

    def _add(self, w):
        import xxhash

        if self.n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        h = xxhash.xxh64_intdigest
        self.table[self.n] = h(w, 1), h(w[:4], 2), h(w[:5], 3)
        self.ids[w] = self.n
        self.n += 1
        return self.n - 1

    def of(self, text):
        """Coordinates of a text, repeats included."""
        if self.n > self.most:
            self.forget()
        get = self.ids.get
        found = [i if (i := get(w)) is not None else self._add(w) for w in _WORD(text.lower())]
        if not found:
            return np.zeros(0, np.int64)
        t = self.table[np.array(found)]
        w = t[:, 0]
        with np.errstate(over="ignore"):
            near = (w[:-1] * _MIX[0] ^ w[1:]) * _MIX[1]
            skip = (w[:-2] * _MIX[0] ^ w[2:]) * _MIX[2]
            every = np.concatenate([t.ravel() * _MIX[0], near, skip])
        return (every >> self.shift).astype(np.int64)


def train(data, bits=BITS, alpha=0.3, beta=1.0, l1=2.0, l2=1.0, epochs=3):
    """FTRL-proximal over (distinct coordinates, label 0 or 1, weight of the row); returns (coordinates, weights, bias)."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = bias = 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i, y, c in data:
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = (p - y) * c
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] = zi + g - s * w
            n[i] = ni + g * g
            sb = ((nb + g * g) ** 0.5 - nb**0.5) / alpha
            zb, nb = zb + g - sb * bias, nb + g * g
            bias = -zb / ((beta + nb**0.5) / alpha)
    w = weights(z, n)
    at = np.nonzero(w)[0]
    return at, w[at].astype(np.float32), float(bias)


def held_out(key):
    """True where crc32 of the key as text is divisible by 5 (a null key: the empty text): never learnt from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs, labels, key="doc_id", text="text", label="toxic", max_rows=MAX_ROWS, **settings):
    """A model (coordinates, weights, bias) from labelled documents that are not held out.

    At most half of ``max_rows`` come from each class. Null labels and keys are left out; a key labelled twice counts
    by its larger label, and of documents that share a key one is learnt from. Without labelled rows of both classes
    the model is empty with bias -35, so nothing is rejected. Texts are hashed in parallel; training runs in one task, over
    the coordinates of the bounded sample only.
    """
    named = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").where(~held_out(F.col("k")))
    named = named.groupBy("k").agg(F.max("y").alias("y"))
    some = [named.where(F.col("y") == y).orderBy(F.xxhash64(F.lit("sample"), "k"), "k").limit(max_rows // 2) for y in (0, 1)]
    chosen = stage(some[0].union(some[1]), "sample")  # at most max_rows rows of two numbers
    sizes = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), -35.0
    used = {y: min(sizes[y], max_rows // 2) for y in sizes}
    cost = {y: (sizes[y] / used[y]) / min(sizes[k] / used[k] for k in sizes) for y in sizes}  # a class sampled more thinly counts for more
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    bits = settings.get("bits", BITS)

    def hashed(batches):
        feats = Features(bits)
        for b in batches:
            x = [np.unique(feats.of(t or "")).astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.int32())), b.column(2)], ["k", "x", "y"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = stage(rows.dropDuplicates(["k"]).select("k", "t", "y").mapInArrow(hashed, f"k {kind}, x array<int>, y int"), "train")

    def run(batches):
        data = []
        for b in batches:
            x = b.column(1)
            data += [(k, x[i].values.to_numpy(), y) for i, (k, y) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist()))]
        data.sort(key=lambda r: (hash_of(r[0]), r[0]))
        at, w, bias = train([(x, y, cost[y]) for _, x, y in data], **settings)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w.astype(np.float64), bias))], ["at", "w"])

    got = rows.coalesce(1).mapInArrow(run, "at long, w double").toPandas()
    return got["at"].to_numpy()[:-1], got["w"].to_numpy()[:-1].astype(np.float32), float(got["w"].iloc[-1])


def hash_of(x):
    import xxhash

    return xxhash.xxh64_intdigest(str(x), 7)


def add_score(docs, model, text="text", out="score", bits=BITS, keep=None):
    """``keep`` columns (all, unless named) plus ``out``: the probability of label 1 of the whole text; null counts as empty."""
    at, w, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((at, w, bias))
    cols = list(keep if keep is not None else docs.columns)
    held = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(text).alias(fresh("_text", cols)))

    def run(batches):
        at, w, bias = sent.value
        dense = np.zeros(1 << bits, np.float32)
        dense[at] = w
        feats = Features(bits)
        for b in batches:
            scores = []
            for t in b.column(len(cols)).to_pylist():
                i = feats.of(t or "")
                scores.append(float(dense[np.unique(i[dense[i] != 0])].sum()) + bias)
            p = 1 / (1 + np.exp(-np.clip(np.array(scores, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(p)], [*cols, out])

    from pyspark.sql.types import DoubleType

    return held.mapInArrow(run, held.select(*[f"`{c}`" for c in cols]).schema.add(out, DoubleType()))


def keep_clean(docs, labels, key="doc_id", text="text", threshold=0.5, **settings):
    """The rows of ``docs``, same columns, whose score is under ``threshold``. Repeated rows and null texts are kept alike."""
    s = fresh("_score", docs.columns)
    return add_score(docs, fit(docs, labels, key, text, **settings), text, s).where(F.col(s) < threshold).drop(s)


def op10_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = add_score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
