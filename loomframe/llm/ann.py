"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``sample`` vectors, the documented parameter) of unit vectors; every row is then
sent down it to a leaf. A query walks the tree with a priority queue of nodes, nearest centroid first, and visits leaves
in that order. How many leaves is calibrated, not guessed: a bounded set of calibration queries is compared with all
rows exactly, and visits widen until their recall reaches ``target``.

Queries meet rows by buckets of neighbouring leaves, in blocks of bounded size on both sides. Of identical vectors only the k + 1 with the
smallest ids can ever be among anyone's k nearest, so no more are compared; identical queries are searched once.
"""

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .storage import smallest, stage

SAMPLE = 40_000
LEAF = 256
BRANCH = 8
BLOCK, QUERY_BLOCK = 4096, 4096
CALIBRATION = 200
#: Leaves are visited until this many rows, at least, were seen.
LEAST_SEEN = 64


def _unit(x):
    x = np.asarray(x, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tree:
    """Nodes as arrays: ``centroid``, ``children`` (empty for a leaf), ``leaf`` (its number, or -1)."""

    def __init__(self, unit, rows, leaf=LEAF, branch=BRANCH, seed=7):
        rng = np.random.default_rng(seed)
        self.centroid, self.children, self.leaf, self.n_leaves = [np.zeros(unit.shape[1])], [[]], [-1], 0
        work, per = [(0, np.arange(len(unit)))], rows / max(1, len(unit))
        while work:
            node, at = work.pop()
            parts = self._split(unit[at], branch, rng) if len(at) * per > leaf and len(at) >= 2 * branch else None
            if parts is None:
                self.leaf[node], self.n_leaves = self.n_leaves, self.n_leaves + 1
                continue
            for c, mine in parts:
                self.centroid.append(c)
                self.children.append([])
                self.leaf.append(-1)
                self.children[node].append(len(self.leaf) - 1)
                work.append((len(self.leaf) - 1, at[mine]))
        self.stack = [np.array([self.centroid[c] for c in cs]) for cs in self.children]

    @staticmethod
    def _split(x, branch, rng, rounds=12):
        c = x[rng.choice(len(x), branch, replace=False)]
        for _ in range(rounds):
            own = np.argmax(x @ c.T, axis=1)
            c = np.array([_unit(x[own == i].sum(axis=0, keepdims=True) + 1e-12)[0] if (own == i).any() else x[rng.integers(len(x))] for i in range(branch)])
        own = np.argmax(x @ c.T, axis=1)
        parts = [(c[i], own == i) for i in range(branch) if (own == i).any()]
        return parts if len(parts) > 1 else None

    def assign(self, unit):
        """Leaf number of each row, by the nearest child at every level."""
        out, work = np.zeros(len(unit), np.int64), [(0, np.arange(len(unit)))]
        while work:
            node, at = work.pop()
            if self.leaf[node] >= 0:
                out[at] = self.leaf[node]
            elif len(at):
                own = np.argmax(unit[at] @ self.stack[node].T, axis=1)
                work += [(c, at[own == i]) for i, c in enumerate(self.children[node])]
        return out

    def visit(self, q):
        """Leaf numbers in best-bin-first order."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            for d, c in zip(1.0 - self.stack[node] @ q, self.children[node]):
                heapq.heappush(heap, (float(d), c))


def usable(vectors, key="vec_id", vector="embedding", size=None):
    """(id, v): rows that take part. Left out: null ids, and vectors that are null, empty, zero, hold a null, NaN or
    infinite component, or differ in length from ``size``, or if that is None from the most common length (the smallest of these on a tie). An id is one
    candidate: repeated rows count once, and of different vectors under one id the least, as arrays compare, takes part."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False))).withColumn("v", v.cast("array<double>"))
    if size is None:
        found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        size = found["d"] if found else 0
    return rows.where(F.size("v") == size).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column):
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _scores(a, b):
    """Cosines of matching rows, in double precision and in one fixed order of summation."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _best(q_ids, q, ids, x, k, allowed=None):
    """(query, id, score) of the k best candidates of every query (of those ``allowed``); ties to smaller ids."""
    rough = _unit(q) @ _unit(x).T
    if allowed is not None:
        rough[~allowed] = -np.inf
    take = min(len(ids), 2 * k + 6)
    at = np.argpartition(-rough, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(len(ids)), (len(q), 1))
    a, b = np.repeat(np.arange(len(q)), at.shape[1]), at.ravel()
    if allowed is not None:
        a, b = a[allowed[a, b]], b[allowed[a, b]]
    s = _scores(q[a], x[b])
    order = np.lexsort((ids[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    first = np.concatenate([[0], np.nonzero(np.diff(a))[0] + 1]) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    keep = rank < k
    return q_ids[a[keep]], ids[b[keep]], s[keep]


class Index:
    """``fit`` once, then ``search``. ``visits`` is the calibrated number of leaves, ``recall`` the recall measured there."""

    def __init__(self, vectors, key="vec_id", vector="embedding", k=5, target=0.97, sample=SAMPLE, leaf=LEAF):
        self.k, spark = k, vectors.sparkSession
        rows = usable(vectors, key, vector)
        same = Window.partitionBy("v").orderBy("id")
        rows = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n")  # limited before the shuffle
        rows = stage(rows, "usable")
        n = rows.count()
        h = F.xxhash64(F.lit("tree"), "id")
        first = rows.select(F.size("v")).first()
        self.size = first[0] if first else 0
        drawn = smallest(rows, [h, F.col("id")], h < int(-(2**63) + 2**64 * min(0.99, 1.2 * sample / max(n, 1) + 1e-9)), sample, n)
        self.tree = Tree(_unit(np.stack(drawn["v"])), n, leaf) if n else None
        sent = self._sent = spark.sparkContext.broadcast(self.tree)

        def assign(batches):
            for b in batches:
                leaf = sent.value.assign(_unit(_matrix(b.column(1)))) if b.num_rows else []
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], ["id", "v", "leaf"])

        self.rows = stage(rows.mapInArrow(assign, "id long, v array<double>, leaf long"), "leaves")
        self.counts = {r["leaf"]: r["n"] for r in self.rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # as many as leaves
        self.visits, self.recall = self._calibrate(drawn.head(CALIBRATION), target) if n else (1, 1.0)

    def exact(self, ids, q):
        """(query, id, score, leaf): the true k nearest of a bounded set of queries among all rows."""
        k = self.k
        sent = self.rows.sparkSession.sparkContext.broadcast((np.asarray(ids), np.asarray(q, np.float64)))

        def run(batches):
            qi, qv = sent.value
            best = None
            for b in batches:
                if not b.num_rows:
                    continue
                x, own, leaf = _matrix(b.column(1)), b.column(0).to_numpy(), b.column(2).to_numpy()
                a, i, s = _best(qi, qv, own, x, k + 1)
                leaves = dict(zip(own.tolist(), leaf.tolist()))
                got = pd.DataFrame({"q": a, "id": i, "score": s, "leaf": [leaves[j] for j in i.tolist()]})
                best = pd.concat([best, got]).sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q").head(k + 1) if best is not None else got
            if best is not None:
                yield pa.RecordBatch.from_pandas(best[best["q"] != best["id"]], preserve_index=False)

        got = self.rows.mapInArrow(run, "q long, id long, score double, leaf long")
        w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def _calibrate(self, drawn, target):
        q = np.stack(drawn["v"])
        truth = self.exact(drawn["id"].to_numpy(), q).select("q", "leaf").toPandas()  # k rows a calibration query
        order = {i: {leaf: n for n, leaf in enumerate(self.tree.visit(u))} for i, u in zip(drawn["id"], _unit(q))}
        at = np.sort([order[a][b] for a, b in zip(truth["q"], truth["leaf"])])
        if not len(at):
            return 1, 1.0
        need = int(at[max(0, math.ceil(target * len(at)) - 1)]) + 1
        return need, float((at < need).mean())

    def search(self, queries, key="vec_id", vector="embedding"):
        """query_id, rank, vec_id, score of every usable query row's k nearest (all candidates, if fewer). Queries of
        another length than the index's vectors take no part; an empty index or no queries give no rows."""
        k, spark = self.k, self.rows.sparkSession
        asked = usable(queries, key, vector, self.size)
        if self.tree is None:
            return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
        asked = stage(asked, "asked")
        one = asked.groupBy("v").agg(F.min("id").alias("q"))
        sent, visits = self._sent, self.visits
        # neighbouring leaves share a bucket of up to BLOCK rows, so a query brings back k + 1 rows a bucket, not a leaf
        bucket, last, held = {}, 0, 0
        for leaf in sorted(self.counts):
            if held and held + self.counts[leaf] > BLOCK:
                last, held = last + 1, 0
            bucket[leaf], held = last, held + self.counts[leaf]
        known = spark.sparkContext.broadcast((self.counts, bucket))

        def walk(batches):
            counts, bucket = known.value
            for b in batches:
                x, at, to, leaves = _unit(_matrix(b.column(0))) if b.num_rows else [], [], [], []
                for i, u in enumerate(x):
                    seen, mine = 0, {}
                    for n, leaf in enumerate(sent.value.visit(u)):
                        if n >= visits and seen >= LEAST_SEEN:
                            break
                        if leaf in counts:
                            mine.setdefault(bucket[leaf], []).append(leaf)
                            seen += counts[leaf]
                    at += [i] * len(mine)
                    to += list(mine)
                    leaves += list(mine.values())
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(1).take(take), b.column(0).take(take), pa.array(to, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))], ["q", "v", "bucket", "leaves"])

        walks = stage(one.mapInArrow(walk, "q long, v array<double>, bucket long, leaves array<long>"), "walks")
        asked_of = {r["bucket"]: r["n"] for r in walks.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        filled = {}
        for leaf, n in self.counts.items():
            filled[bucket[leaf]] = filled.get(bucket[leaf], 0) + n
        blocks = [(leaf, c, math.ceil(filled[c] / BLOCK), math.ceil(asked_of.get(c, 0) / QUERY_BLOCK)) for leaf, c in bucket.items()]
        blocks = F.broadcast(spark.createDataFrame(blocks, "leaf long, bucket long, blocks int, q_blocks int"))  # as many as leaves
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = self.rows.join(blocks.where("q_blocks > 0"), "leaf").select("bucket", "leaf", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), spread("q_blocks").alias("q_block"), "id", "v")
        each = F.broadcast(blocks.select("bucket", "blocks", "q_blocks").distinct())
        walks = walks.join(each, "bucket").select("bucket", "leaves", spread("blocks").alias("block"), F.pmod(F.xxhash64("q"), F.col("q_blocks")).cast("int").alias("q_block"), "q", "v")

        def meet(left, right):
            if not len(left) or not len(right):
                return pd.DataFrame({"q": [], "id": [], "score": []}).astype({"q": "int64", "id": "int64"})
            own, at = np.unique(right["leaf"].to_numpy(), return_inverse=True)
            allowed = np.stack([np.isin(own, leaves) for leaves in left["leaves"]])[:, at]
            q, i, s = _best(left["q"].to_numpy(), np.stack(left["v"]), right["id"].to_numpy(), np.stack(right["v"]), k + 1, allowed)
            return pd.DataFrame({"q": q, "id": i, "score": s})

        on = ["bucket", "block", "q_block"]
        found = walks.groupBy(*on).cogroup(rows.groupBy(*on)).applyInPandas(meet, "q long, id long, score double")
        w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        top = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).drop("n")
        every = asked.join(one, "v").select(F.col("id").alias("query_id"), "q").join(top, "q").where(F.col("query_id") != F.col("id"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_nearest(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return Index(vectors).search(vectors.where("vec_id % 50 = 0"))
