"""Classical models on Spark ML, and their metrics as plain aggregations."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Bucketizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import col_of
from ..functions.work import Scratch
from .ranks import quantiles


def prepare(df, features, target=None, keep=()):
    """Rows without nulls in the chosen columns: ``features`` vector, ``label`` (texts as sorted labels), ``keep`` columns."""
    used = [*features, *([target] if target else [])]
    out = df.dropna(subset=used)
    if target and dict(df.dtypes)[target] == "string":
        out = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(out).transform(out)
    elif target:
        out = out.withColumn("label", col_of(target).cast("double"))
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(out)
    return vectors.select(*[col_of(k) for k in keep], "features", *(["label"] if target else []))


def split_stratified(df, key, label, test=0.2, seed=42):
    """``is_test``: in every class, the first ``test`` share of rows (rounded) by a seeded hash of the key, then by key.

    A histogram of the hash's top 12 bits tells, for every class, the bucket in which the share ends; rows below it
    are in, rows above it out, and only the bucket's own rows are ranked. A null label is a class of its own.
    """
    h, b = F.xxhash64(F.lit(seed), col_of(key)), F.shiftright(F.xxhash64(F.lit(seed), col_of(key)), 52).cast("int")
    counts = df.groupBy(col_of(label).alias("__y"), b.alias("__b")).agg(F.count("*").alias("__n"))
    every, up_to = Window.partitionBy("__y"), Window.partitionBy("__y").orderBy("__b")
    told = counts.select("__y", "__b", "__n", F.round(F.sum("__n").over(every) * test).cast("long").alias("__want"), (F.sum("__n").over(up_to) - F.col("__n")).alias("__before"))
    told = told.where((F.col("__before") < F.col("__want")) & (F.col("__before") + F.col("__n") >= F.col("__want")))
    border = told.select("__y", F.col("__b").alias("__at"), (F.col("__want") - F.col("__before")).alias("__left"))
    rows = df.join(border, col_of(label).eqNullSafe(F.col("__y")), "left")  # no border: a class of which nothing is in
    rank = F.row_number().over(Window.partitionBy("__y").orderBy(h, col_of(key)))
    edge = rows.where(b == F.col("__at")).withColumn("is_test", rank <= F.col("__left"))
    rest = rows.where(F.col("__at").isNull() | (b != F.col("__at"))).withColumn("is_test", F.coalesce(b < F.col("__at"), F.lit(False)))
    return edge.unionByName(rest).drop("__y", "__at", "__left")


def classifier(kind, **settings):
    """An untrained classifier by name: logreg, rf, svm (RBF kernel), svm_linear, gbt (two classes), gbt_multi."""
    return {
        "logreg": lambda: LogisticRegression(maxIter=settings.get("rounds", 100)),
        "rf": lambda: RandomForestClassifier(numTrees=settings.get("trees", 100), seed=42),
        "svm": lambda: RbfSvm(**settings),
        "svm_linear": lambda: OneVsRest(classifier=LinearSVC(maxIter=settings.get("rounds", 50))),
        "gbt": lambda: BinnedGbt(settings.get("rounds", 100)),
        "gbt_multi": lambda: OneVsRest(classifier=GBTClassifier(maxIter=settings.get("rounds", 100), seed=42)),
    }[kind]()


def regressor(kind, **settings):
    return {
        "linreg": lambda: LinearRegression(),
        "rf": lambda: RandomForestRegressor(numTrees=settings.get("trees", 100), seed=42),
        "gbt": lambda: GBTRegressor(maxIter=settings.get("rounds", 100), seed=42),
    }[kind]()


def fourier_features(df, vector, n=128, gamma=1.0, seed=42, out="features"):
    """Random Fourier features cos(w x + b) of an array column, as an array: an RBF kernel for linear models."""
    size = df.select(F.size(vector)).first()[0]
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, (2 * gamma) ** 0.5, (n, size)), rng.uniform(0, 2 * np.pi, n)
    parts = [F.cos(F.aggregate(F.zip_with(col_of(vector), F.array(*[F.lit(float(x)) for x in row]), lambda a, c: a * c), F.lit(0.0), lambda s, x: s + x) + F.lit(float(bias))) for row, bias in zip(w, b)]
    return df.withColumn(out, F.array(*parts))


class RbfSvm:
    """A support vector machine with an RBF kernel, squared hinge loss and probabilities.

    Features are standardised and mapped to ``n`` random Fourier features, whose inner product approximates the kernel
    (exp(-gamma |x - y|^2), gamma 1 / dimensions unless given). In their space the machine of each class (one for two
    classes) is found by Newton steps in the primal: a step solves for the rows inside the margin, whose products are summed
    in parallel, and the steps end when those rows stay the same. That takes four fifths of the rows; Platt scaling fits a
    sigmoid to the margins, counted in steps of a thousandth, on the held-out fifth. Rows are dealt by a hash of their features.
    """

    def __init__(self, n=256, gamma=None, seed=42, reg=1e-4, rounds=30, most_classes=100):
        self.n, self.gamma, self.seed, self.reg, self.rounds, self.most_classes = n, gamma, seed, reg, rounds, most_classes

    def fit(self, data):
        """``data``: features (vector), label (double); two classes at least."""
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(data)
        classes = sorted(r[0] for r in data.select("label").distinct().limit(self.most_classes + 1).collect())
        if not 2 <= len(classes) <= self.most_classes:
            raise ValueError(f"an SVM needs 2 to {self.most_classes} classes, not {len(classes)}")
        rng, d = np.random.default_rng(self.seed), len(scaler.mean)
        gamma = self.gamma or 1.0 / d
        std = np.where(scaler.std.toArray() > 0, scaler.std.toArray(), 1.0)
        model = RbfSvmModel(classes, scaler.mean.toArray(), std, rng.normal(0, (2 * gamma) ** 0.5, (d, self.n)), rng.uniform(0, 2 * np.pi, self.n))
        work, x = Scratch(data.sparkSession, "svm"), vector_to_array("features")
        rows = work.write(data.select(x.alias("x"), col_of("label").alias("y"), (F.pmod(F.xxhash64(F.lit(self.seed), x), F.lit(5)) == 0).alias("held")))
        ours = classes[1:] if len(classes) == 2 else classes
        model.machines = self._machines(rows.where("not held"), model, ours)
        model.sigmoids = [self._sigmoid(*v) for v in self._margins(rows.where("held"), model, ours)]
        work.remove()
        return model

    def _machines(self, rows, model, ours):
        """A row of weights a class, the last one the intercept."""
        k, at = self.n + 1, np.triu_indices(self.n + 1)
        total, w = rows.count(), np.zeros((len(ours), k))

        def products(batches):
            h, g = np.zeros((len(ours), k, k)), np.zeros((len(ours), k))
            for b in batches:
                if b.num_rows:
                    z, y = model.with_one(_matrix(b.column("x"))), b.column("y").to_numpy()
                    for i, c in enumerate(ours):
                        t = np.where(y == c, 1.0, -1.0)
                        inside = t * (z @ w[i]) < 1
                        h[i] += z[inside].T @ z[inside]
                        g[i] += t[inside] @ z[inside]
            cells = np.concatenate([np.concatenate([h[i][at], g[i]]) for i in range(len(ours))])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "v"])

        for _ in range(self.rounds):
            got = rows.select("x", "y").mapInArrow(products, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()  # n ** 2 / 2 rows a class
            cells = np.zeros(len(ours) * (len(at[0]) + k))
            cells[got["cell"].to_numpy()] = got["v"].to_numpy()
            before, w = w, w.copy()
            for i, part in enumerate(cells.reshape(len(ours), -1)):
                h = np.zeros((k, k))
                h[at] = part[: len(at[0])]
                h += np.triu(h, 1).T
                h[np.diag_indices(k)] += np.append(np.full(k - 1, self.reg * total), 1e-9 * total)
                w[i] = np.linalg.solve(h, part[len(at[0]) :])
            if np.abs(w - before).max() <= 1e-7 * (1 + np.abs(w).max()):
                break
        return w

    @staticmethod
    def _margins(rows, model, ours):
        """[(margins, counts of others, counts of the class)] a class, margins in thousandths."""

        def count(batches):
            for b in batches:
                if b.num_rows:
                    m, y = model.margins(_matrix(b.column("x"))), b.column("y").to_numpy()
                    steps = np.rint(np.clip(m, -20, 20) * 1000).astype(np.int64)
                    for i, c in enumerate(ours):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), i)), pa.array(steps[:, i]), pa.array((y == c).astype(np.int64))], ["i", "m", "hit"])

        got = rows.select("x", "y").mapInArrow(count, "i long, m long, hit long").groupBy("i", "m").agg(F.count("*").alias("n"), F.sum("hit").alias("hits")).toPandas()  # 40,001 rows a class at most
        for i in range(len(ours)):
            one = got[got["i"] == i]
            yield one["m"].to_numpy(float) / 1000, (one["n"] - one["hits"]).to_numpy(float), one["hits"].to_numpy(float)

    @staticmethod
    def _sigmoid(m, no, yes):
        """(a, b) of 1 / (1 + exp(-(a m + b))), by Newton steps on targets drawn in from 0 and 1 (Platt)."""
        hi, lo = (yes.sum() + 1) / (yes.sum() + 2), 1 / (no.sum() + 2)
        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -60, 60)))
            r, v = yes * (hi - p) + no * (lo - p), (yes + no) * p * (1 - p)
            grad = np.array([(r * m).sum(), r.sum()])
            hess = np.array([[(v * m * m).sum(), (v * m).sum()], [(v * m).sum(), v.sum()]]) + 1e-9 * np.eye(2)
            step = np.clip(np.linalg.solve(hess, grad), -5, 5)
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-9:
                break
        return a, b


#: A feature of so many values at most has its bins drawn from counts of them.
VALUES = 4096


class BinnedGbt:
    """Boosted trees of two classes: MLlib's GBTClassifier, trained on bins and how many rows fall in each combination of them.

    Trees look at features by bins only, ``bins`` at most (MLlib's own default), so rows that are alike in all bins and in the label are
    one row of so much weight, and a round costs as many rows as there are combinations. Borders are MLlib's, by counts of all rows
    in place of some 10,000 drawn ones; of features of more than VALUES values they are exact quantiles.
    """

    def __init__(self, rounds=100, bins=32, seed=42):
        self.rounds, self.bins, self.seed = rounds, bins, seed

    def fit(self, data):
        """``data``: features (vector), label (0 or 1)."""
        first = data.select(F.size(vector_to_array("features"))).first()
        if first is None:
            raise ValueError("no rows to learn from")
        work, n = Scratch(data.sparkSession, "gbt"), first[0]
        rows = work.write(_numbers(data, n).select(*[f"__f{i}" for i in range(n)], "label"))
        cuts = self._cuts(rows, n)
        binned = _binned(rows, cuts).groupBy(*[f"__b{i}" for i in range(n)], "label").agg(F.count("*").cast("double").alias("__n"))
        gbt = GBTClassifier(maxIter=self.rounds, seed=self.seed, maxBins=self.bins, featuresCol="__binned", weightCol="__n")
        model = BinnedGbtModel(cuts, gbt.fit(_assembled(work.write(binned), n)))
        work.remove()
        return model

    def _cuts(self, rows, n):
        """Borders of the bins of each feature; a value equal to one lies below it, as in MLlib."""

        def values(batches):
            seen = [(np.zeros(0), np.zeros(0))] * n
            for b in batches:
                for i, (v, c) in enumerate(seen):
                    if len(v) <= VALUES:
                        own, many = np.unique(b.column(i).to_numpy(), return_counts=True)
                        v, at = np.unique(np.append(v, own), return_inverse=True)
                        seen[i] = v, np.bincount(at, np.append(c, many), len(v))
            for i, (v, c) in enumerate(seen):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(min(len(v), VALUES + 1), i)), pa.array(v[: VALUES + 1]), pa.array(c[: VALUES + 1])], ["i", "v", "c"])

        names = [f"__f{i}" for i in range(n)]
        got = rows.select(*names).mapInArrow(values, "i long, v double, c double").groupBy("i", "v").agg(F.sum("c").alias("c")).cache()
        held = {r["i"]: r["count"] for r in got.groupBy("i").count().collect()}
        few = [i for i in range(n) if held[i] <= VALUES]
        counts = got.where(F.col("i").isin(few)).orderBy("i", "v").collect()  # VALUES rows a feature at most
        got.unpersist()
        borders = quantiles(rows, [names[i] for i in range(n) if i not in few], [j / self.bins for j in range(1, self.bins)])
        cuts = [borders[c] if c in borders else self._spaced([(r["v"], r["c"]) for r in counts if r["i"] == i]) for i, c in enumerate(names)]
        return [sorted({x for x in c if x < np.inf}) for c in cuts]

    def _spaced(self, counts):
        """Borders between values, of (value, count) in order: all of them, or those nearest to equal shares, chosen as MLlib chooses."""
        between = [(a + b) / 2 if (a + b) / 2 < b else a for (a, _), (b, _) in zip(counts, counts[1:])]
        if len(counts) <= self.bins:
            return between
        share = sum(c for _, c in counts) / self.bins
        out, below, target = [], counts[0][1], share
        for border, (_, c) in zip(between, counts[1:]):
            if abs(below - target) < abs(below + c - target):
                out.append(border)
                target += share
            below += c
        return out


def _numbers(data, n):
    """``data`` and the numbers of its vectors as columns."""
    x = vector_to_array("features")
    return data.withColumns({f"__f{i}": F.get(x, F.lit(i)) for i in range(n)})


def _binned(data, cuts):
    """``data`` and the bin of each number."""
    cut = [i for i, c in enumerate(cuts) if c]
    out = data.withColumns({f"__b{i}": F.lit(0.0) for i, c in enumerate(cuts) if not c})
    if not cut:
        return out
    splits = [[-np.inf, *np.nextafter(cuts[i], np.inf).tolist(), np.inf] for i in cut]
    out = Bucketizer(splitsArray=splits, inputCols=[f"__f{i}" for i in cut], outputCols=[f"__b{i}" for i in cut]).transform(out)
    return out.withColumns({f"__b{i}": F.col(f"__b{i}") + 0.0 for i in cut})  # numbers in order: a Bucketizer marks them as categories


def _assembled(data, n):
    return VectorAssembler(inputCols=[f"__b{i}" for i in range(n)], outputCol="__binned").transform(data)


class BinnedGbtModel:
    def __init__(self, cuts, trees):
        self.cuts, self.trees = cuts, trees

    @property
    def featureImportances(self):
        return self.trees.featureImportances

    def transform(self, data):
        """``data`` plus ``rawPrediction``, ``probability`` and ``prediction``."""
        n = len(self.cuts)
        made = self.trees.transform(_assembled(_binned(_numbers(data, n), self.cuts), n))
        return made.drop("__binned", *[f"__{c}{i}" for c in "fb" for i in range(n)])


def _matrix(column):
    return np.asarray(column.flatten()).reshape(len(column), -1)


class RbfSvmModel:
    def __init__(self, classes, mean, std, waves, phases):
        self.classes, self.mean, self.std, self.waves, self.phases, self.machines, self.sigmoids = classes, mean, std, waves, phases, None, None

    def with_one(self, x):
        """Fourier features of rows, and a column of ones."""
        z = np.sqrt(2.0 / len(self.phases)) * np.cos((x - self.mean) / self.std @ self.waves + self.phases)
        return np.hstack([z, np.ones((len(x), 1))])

    def margins(self, x):
        return self.with_one(x) @ self.machines.T

    def probabilities(self, x):
        a, b = np.array(self.sigmoids).T
        p = 1 / (1 + np.exp(-np.clip(self.margins(x) * a + b, -500, 500)))
        p = np.hstack([1 - p, p]) if len(self.classes) == 2 else p
        return p / np.maximum(p.sum(1, keepdims=True), 1e-300)

    def transform(self, data):
        """``data`` plus ``probability`` (array, in the order of the sorted classes) and ``prediction``."""
        of = self.probabilities

        @F.pandas_udf("array<double>")
        def p(x: pd.Series) -> pd.Series:
            return pd.Series(list(of(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

        out = data.withColumn("probability", p(vector_to_array("features")))
        at = F.array_position("probability", F.array_max("probability")).cast("int") - 1
        return out.withColumn("prediction", F.get(F.array(*[F.lit(float(c)) for c in self.classes]), at))


def kmeans(data, k, seeds=(42,), scale=False):
    """(model, predictions): the best of several seeds by training cost."""
    steps = [StandardScaler(inputCol="features", outputCol="scaled")] if scale else []
    best = None
    for s in seeds:
        model = Pipeline(stages=[*steps, KMeans(k=k, seed=s, featuresCol="scaled" if scale else "features", predictionCol="cluster")]).fit(data)
        cost = model.stages[-1].summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, model)
    return best[1], best[1].transform(data)


def cluster_label(df, key, predictions):
    """``df`` with its rows' cluster; rows that were not clustered get null."""
    return df.join(predictions.select(col_of(key), "cluster"), key, "left")


def cluster_sizes(predictions):
    return predictions.groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster")


def accuracy(pred, label="label", prediction="prediction"):
    return pred.agg(F.round(F.avg((col_of(label) == col_of(prediction)).cast("double")), 6).alias("accuracy"))


def confusion(pred, label="label", prediction="prediction"):
    """(label, prediction, n), one row a pair that occurs."""
    return pred.groupBy(col_of(label).alias("label"), col_of(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def confusion_matrix(pred, classes, label="label", prediction="prediction"):
    return pred.groupBy(col_of(label).alias("label")).pivot(prediction, list(classes)).count().fillna(0)


def classification_report(pred, label="label", prediction="prediction"):
    """(class, precision, recall, f1, support) with rows "macro" and "weighted"."""
    side = lambda c, name: F.struct(F.col(c).cast("string").alias("class"), F.lit(name).alias("side"), F.col("n").alias("n"), (F.col("label") == F.col("prediction")).alias("hit"))
    c = confusion(pred, label, prediction).select(F.inline(F.array(side("label", "y"), side("prediction", "p"))))
    tp = F.sum(F.when((F.col("side") == "y") & F.col("hit"), F.col("n")).otherwise(0))
    per = c.groupBy("class").agg(tp.alias("tp"), F.sum(F.when(F.col("side") == "y", F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("predicted"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    per = per.withColumn("precision", zero(F.try_divide(F.col("tp"), F.col("predicted")))).withColumn("recall", zero(F.try_divide(F.col("tp"), F.col("support"))))
    per = per.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    cols = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro").alias("class"), *[F.avg(m).alias(m) for m in cols], F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted").alias("class"), *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in cols], F.sum("support").alias("support"))
    out = per.select("class", *cols, "support").union(macro).union(weighted)
    return out.select("class", *[F.round(m, 6).alias(m) for m in cols], "support")


def regression_metrics(pred, label="label", prediction="prediction"):
    """One row: r2, mae, rmse."""
    y, p = col_of(label).cast("double"), col_of(prediction).cast("double")
    r2 = 1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))
    return pred.agg(F.round(r2, 6).alias("r2"), F.round(F.avg(F.abs(y - p)), 6).alias("mae"), F.round(F.sqrt(F.avg((y - p) * (y - p))), 6).alias("rmse"))


def actual_vs_pred(pred, key, label="label", prediction="prediction"):
    return pred.select(col_of(key), col_of(label).alias("actual"), col_of(prediction).alias("predicted"))


def importances(model, features):
    """(feature, importance) of a tree model, most first."""
    spark = SparkSession.getActiveSession()
    rows = sorted(((f, float(w)) for f, w in zip(features, model.featureImportances.toArray())), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


#: Pivots of the exact nearest-neighbour search, at most; numbers in a block of its training rows; test rows that meet a block at once.
PIVOTS, BLOCK, QUERY_BLOCK = 256, 2**20, 4096


def _nearest_of(q, qv, t, tv, k):
    """(place in ``q``, place in ``t``, squared distance) of the exact k nearest of every row of ``qv`` among ``tv``, ties to the smaller
    key of ``t``, none of the same key. ``t`` is sorted.

    A product of matrices gives distances up to rounding; those that may be among the k least are summed again term by term.
    """
    out = []
    size = (tv * tv).sum(1)
    same = np.searchsorted(t, q, "left"), np.searchsorted(t, q, "right")
    for lo in range(0, len(q), step := max(1, 2**21 // len(t))):
        x = qv[lo : lo + step]
        rough = (x * x).sum(1)[:, None] - 2 * x @ tv.T + size[None, :]
        off = 8 * (x.shape[1] + 8) * np.finfo(float).eps * ((x * x).sum(1) + size.max())  # over twice what rounding can do
        for i in range(len(x)):
            rough[i, same[0][lo + i] : same[1][lo + i]] = np.inf
        most = np.partition(rough, k - 1, axis=1)[:, k - 1] if k < len(t) else np.full(len(x), np.inf)
        for i in range(len(x)):
            at = np.flatnonzero((rough[i] <= most[i] + off[i]) & (rough[i] < np.inf))
            d = np.square(x[i] - tv[at]).cumsum(1)[:, -1]
            first = np.argsort(d, kind="stable")[:k]
            out.append((np.full(len(first), lo + i), at[first], d[first]))
    return [np.concatenate(c) for c in zip(*out)]


def knn(test, train, vector, key, label, k=5):
    """(key, neighbour, distance, rank, label): the exact ``k`` nearest training rows of every test row by squared
    distance, ties to the smaller key; a row is no neighbour of itself. Rows with a null vector or key take no part; vectors
    have one length.

    Training rows belong to the nearest of a bounded set of pivots, and pivots to buckets of about BLOCK numbers. What the triangle
    inequality says about a pivot's rows (their number, least and greatest distance to it) first gives every test row the buckets
    to look at in any case; the k-th distance found there then rules out those that are too far to matter. Test rows meet
    training rows in blocks of bounded size on both sides, and a block keeps k rows a test row.
    """
    work = Scratch(test.sparkSession, "knn")
    given = lambda df: df.where(col_of(vector).isNotNull() & col_of(key).isNotNull())
    t = work.write(given(train).select(col_of(key).alias("t"), col_of(vector).cast("array<double>").alias("tv"), col_of(label).alias("y")))
    q = given(test).select(col_of(key).alias("q"), col_of(vector).cast("array<double>").alias("qv"))
    wanted = max(1, min(PIVOTS, int(t.count() ** 0.5 / 2)))
    drawn = [r[0] for r in t.select("tv", F.xxhash64("t").alias("h")).orderBy("h").limit(wanted).select("tv").collect()]  # PIVOTS rows a task at most
    empty = t.select(F.col("t").alias(key), F.col("t").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"), F.col("y").alias("label")).where("false")
    if not drawn:
        return empty
    pivots = np.unique(np.array(drawn), axis=0)
    middle = pivots.mean(0)  # taken off first, or squares of vectors far from 0 would swallow their distances
    pivots -= middle

    def places(v):
        v = v - middle
        return np.sqrt(np.maximum(0.0, (v * v).sum(1)[:, None] - 2 * v @ pivots.T + (pivots * pivots).sum(1)[None, :]))

    @F.pandas_udf("p int, r double")
    def nearest(x: pd.Series) -> pd.DataFrame:
        d = places(np.stack(x.to_numpy())) if len(x) else np.zeros((0, len(pivots)))
        return pd.DataFrame({"p": d.argmin(1).astype(np.int32), "r": d.min(1)})

    t = work.write(t.withColumn("n", nearest("tv")).select("t", "tv", "y", F.monotonically_increasing_id().alias("row"), "n.p", "n.r"))
    held = {r["p"]: r for r in t.groupBy("p").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()}  # a row a pivot
    size = np.array([held[i]["n"] if i in held else 0 for i in range(len(pivots))])
    lo, hi = (np.array([held[i][f] if i in held else 0.0 for i in range(len(pivots))]) for f in ("lo", "hi"))
    most = max(256, BLOCK // max(1, pivots.shape[1]))
    bucket = np.zeros(len(pivots), np.int32)
    for i in range(1, len(pivots)):
        room = size[:i][bucket[:i] == bucket[i - 1]].sum() + size[i] <= most
        bucket[i] = bucket[i - 1] + (not room)
    filled = np.bincount(bucket, size)

    @F.pandas_udf("array<struct<bucket int, least double, home boolean>>")
    def visits(x: pd.Series) -> pd.Series:
        out = []
        for d in places(np.stack(x.to_numpy())) if len(x) else []:
            slack = 1e-6 * (1 + d.max())
            least = np.where(size > 0, np.maximum(0.0, np.maximum(d - hi, lo - d) - slack), np.inf)
            order = np.argsort(d + hi, kind="stable")
            reach = (d + hi)[order][np.searchsorted(np.cumsum(size[order]), min(k + 1, size.sum()))] + slack  # k + 1 rows surely lie within
            near = np.flatnonzero(least <= reach)
            near = near[np.argsort(least[near] + 1e-9 * d[near], kind="stable")]
            home = set(bucket[near[np.cumsum(size[near]) - size[near] < k + 1]].tolist())
            into = {}
            for j in near:
                into.setdefault(int(bucket[j]), float(least[j]))
            out.append([{"bucket": b, "least": v, "home": b in home} for b, v in into.items()])
        return pd.Series(out, dtype=object)

    def meet(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"q": left["q"][:0], "t": right["t"][:0], "row": right["row"][:0], "distance": np.zeros(0)})
        right = right.sort_values(["t", "row"], kind="stable")
        own, rows = right["t"].to_numpy(), right["row"].to_numpy()
        a, b, d = _nearest_of(left["q"].to_numpy(), np.stack(left["qv"]), own, np.stack(right["tv"]), k)
        return pd.DataFrame({"q": left["q"].to_numpy()[a], "t": own[b], "row": rows[b], "distance": d})

    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    kind = {c: t.schema[c].dataType.simpleString() for c in ("t", "row")}
    kind["q"] = q.schema["q"].dataType.simpleString()
    pivot_of = F.broadcast(test.sparkSession.createDataFrame([(i, int(b)) for i, b in enumerate(bucket)], "p int, bucket int"))  # a row a pivot
    dealt = t.join(pivot_of, "p").select("t", "tv", "row", "bucket")

    def found(looks):
        """(q, t, row, distance): the k nearest of every block that the test rows of ``looks`` are sent to."""
        asked = {r["bucket"]: r["n"] for r in looks.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # as many as pivots
        blocks = [(b, -(-int(filled[b]) // most), -(-n // QUERY_BLOCK)) for b, n in asked.items()]
        blocks = F.broadcast(test.sparkSession.createDataFrame(blocks, "bucket int, blocks int, q_blocks int"))
        left = looks.join(blocks, "bucket").select("bucket", spread("blocks").alias("block"), deal("q", "q_blocks").alias("q_block"), "q", "qv")
        right = dealt.join(blocks, "bucket").select("bucket", deal("row", "blocks").alias("block"), spread("q_blocks").alias("q_block"), "t", "tv", "row")
        on = ["bucket", "block", "q_block"]
        return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(meet, f"q {kind['q']}, t {kind['t']}, row long, distance double")

    looks = work.write(q.withColumn("v", F.explode(visits("qv"))).select("q", "qv", "v.*"))
    top = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "t", "row"))).where(F.col("rank") <= k)
    home = work.write(top(found(looks.where("home"))))
    bound = home.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far")).select("q", F.when(F.col("n") == k, F.sqrt("far") * (1 + 1e-9) + 1e-9).otherwise(F.lit(float("inf"))).alias("far"))
    more = looks.where("not home").join(bound, "q", "left").where(F.col("least") <= F.coalesce("far", F.lit(float("inf"))))
    out = top(home.drop("rank").unionByName(found(work.write(more.select("q", "qv", "bucket")))))
    out = work.write(out).join(t.select("row", "y"), "row")
    return out.select(F.col("q").alias(key), F.col("t").alias("neighbour"), "distance", "rank", F.col("y").alias("label"))


def knn_classify(test, train, vector, key, label, k=5):
    """(key, prediction): the most frequent label of the k nearest, the smallest on a tie."""
    return knn(test, train, vector, key, label, k).groupBy(key).agg(F.mode("label", True).alias("prediction"))
