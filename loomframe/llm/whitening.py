"""Embedding whitening by incremental eigendecomposition.

Every task runs through its vectors and keeps count, exact sums and the spectrum of their scatter matrix; each vector is a centred
rank-one update, for which the secular equation is solved, after deflation of what the update does not touch. Spectra of
tasks are combined in a tree, eigenpair by eigenpair, again as rank-one updates, plus one for the distance of the means.
The result is a basis close to the eigenvectors; a Rayleigh-Ritz step over all vectors (the covariance of their
coordinates in that basis, summed in parallel) makes it exact to double precision.

Vectors are taken as whole numbers, floor(scale * c) + offset, so sums and centred values are exact.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .storage import stage

SCALE, OFFSET = 64, 1_000_000
#: Vectors of a task, and spectra combined by one task.
ROWS, FAN = 20_000, 16
#: Beyond this a whole number is not exact as double; such a component counts as not finite.
LARGEST = 2.0**52
_EPS, _TINY = float(np.finfo(float).eps), float(np.finfo(float).tiny)


def secular(d, z, rho, rounds=60):
    """Roots of 1 + rho * sum(z_j^2 / (d_j - x)) = 0 for rising, different d, nonzero z and rho > 0.

    Returned as (origin, step): root i is d[origin[i]] + step[i], with the origin at the nearer pole so that no digits are
    lost. Each is bracketed between two poles; a rational interpolation through both poles steps fast, bisection is the
    fallback.
    """
    k, w = len(d), rho * z * z
    right = np.append(d[1:], d[-1] + w.sum())
    mid = 0.5 * (d + right)
    at_mid = 1 + (w / (d - mid[:, None])).sum(1)
    low_half = at_mid >= 0  # f rises between two poles, so the root lies left of the middle
    origin = np.where(low_half | (np.arange(k) == k - 1), np.arange(k), np.arange(k) + 1)
    gap = d[None, :] - d[origin][:, None]  # poles seen from each root's origin
    lo, hi = np.where(low_half, d, mid) - d[origin], np.where(low_half, mid, right) - d[origin]
    x = 0.5 * (lo + hi)
    own, nxt = gap[np.arange(k), np.arange(k)], gap[np.arange(k), np.minimum(np.arange(k) + 1, k - 1)]
    left = np.tri(k)
    open_ = np.ones(k, bool)
    for _ in range(rounds):
        r = gap[open_] - x[open_, None]
        r[r == 0] = _TINY
        q = w / r
        dq = q / r
        mine = left if open_.all() else left[open_]
        psi, dpsi = np.einsum("ij,ij->i", q, mine), np.einsum("ij,ij->i", dq, mine)
        phi, dphi = q.sum(1) - psi, dq.sum(1) - dpsi  # poles to the left give psi < 0, to the right phi > 0
        f, scale = 1 + psi + phi, 1 + phi - psi
        at = np.flatnonzero(open_)
        lo[at] = np.where(f < 0, x[at], lo[at])
        hi[at] = np.where(f < 0, hi[at], x[at])
        a, b = own[at] - x[at], nxt[at] - x[at]
        # f ~ c + s / (a - t) + u / (b - t) with the slopes of both sides matched
        last = at == k - 1
        s, u = dpsi * a * a, np.where(last, 0.0, dphi * b * b)
        c = f - dpsi * a - np.where(last, 0.0, dphi * b)
        bb, cc = -(c * (a + b) + s + u), a * b * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(bb * bb - 4 * c * cc, 0))
            t = np.where(bb > 0, -2 * cc / (bb + root), (root - bb) / (2 * c))
            other = np.where(bb > 0, -(bb + root) / (2 * c), 2 * cc / (root - bb))
            t = np.where(last, a + s / c, t)
        inside = lambda v: np.isfinite(v) & (v > lo[at]) & (v < hi[at])
        fast = x[at] + t
        slow = x[at] + other
        new = np.where(inside(fast), fast, np.where(inside(slow) & ~last, slow, 0.5 * (lo[at] + hi[at])))
        settled = (np.abs(f) <= 8 * _EPS * k * scale) | (new == x[at]) | (hi[at] - lo[at] <= 4 * _EPS * np.maximum(np.abs(lo[at]), np.abs(hi[at])))
        x[at] = np.where(settled, x[at], new)
        open_[at] = ~settled
        if not open_.any():
            break
    return origin, x


def rank_one(d, u, v, rho):
    """(d, u) of u diag(d) u' + rho v v', rho >= 0, d rising: eigenvalues rising, eigenvectors as columns."""
    z = u.T @ v
    size = float(z @ z)
    if not size or not rho:
        return d, u
    z, rho = z / np.sqrt(size), rho * size
    small = 8 * _EPS * max(abs(d[-1]), abs(d[0]), rho)
    u, keep = u.copy(), []
    for i in range(len(d)):
        if rho * abs(z[i]) <= small:
            continue  # deflated: the update does not touch this direction
        if keep and d[i] - d[j := keep[-1]] <= small:  # two equal eigenvalues: turned until one has no part in v
            r = float(np.hypot(z[j], z[i]))
            c, s = z[i] / r, z[j] / r
            u[:, [j, i]] = u[:, [j, i]] @ np.array([[c, s], [-s, c]])
            z[j], z[i] = 0.0, r
            keep.pop()
        keep.append(i)
    if not keep:
        return d, u
    keep = np.array(keep)
    dk, zk = d[keep], z[keep]
    if len(keep) == 1:
        new, q = dk + rho * zk * zk, np.ones((1, 1))
    else:
        origin, step = secular(dk, zk, rho)
        away = (dk[:, None] - dk[origin][None, :]) - step[None, :]  # d_i - root_j, exact in its leading digits
        k = len(dk)
        # the vector for which these roots are exact (Gu and Eisenstat), so that the eigenvectors come out orthogonal
        between = dk[:, None] - dk[None, :] + np.eye(k)
        ratio = away / np.where(np.eye(k, dtype=bool), -1.0, between)
        z_hat = np.sqrt(np.abs(np.prod(ratio, 1))) * np.sign(zk)
        q = z_hat[:, None] / away
        q /= np.linalg.norm(q, axis=0)
        new = dk[origin] + step
    d = d.copy()
    d[keep] = new
    u[:, keep] = u[:, keep] @ q
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


class Spectrum:
    """Count, exact sums and the spectrum of the scatter matrix (not divided by the count) of whole-number vectors."""

    def __init__(self, size, n=0, sums=None, d=None, u=None):
        self.n, self.sums = n, [0] * size if sums is None else sums
        self.d, self.u = np.zeros(size) if d is None else d, np.eye(size) if u is None else u

    def _apart(self, n, sums):
        """The difference of two means, exact before it is rounded once."""
        return np.array([b * self.n - a * n for a, b in zip(self.sums, sums)], float) / (self.n * n)

    def add(self, x):
        if self.n:
            self.d, self.u = rank_one(self.d, self.u, self._apart(1, x), self.n / (self.n + 1))
        self.n, self.sums = self.n + 1, [a + b for a, b in zip(self.sums, x)]

    def merge(self, other):
        if not other.n:
            return
        if self.n:
            for value, vector in zip(other.d, other.u.T):
                if value > 0:
                    self.d, self.u = rank_one(self.d, self.u, vector, float(value))
            self.d, self.u = rank_one(self.d, self.u, self._apart(other.n, other.sums), self.n * other.n / (self.n + other.n))
        else:
            self.d, self.u = other.d, other.u
        self.n, self.sums = self.n + other.n, [a + b for a, b in zip(self.sums, other.sums)]

    COLUMNS = "n long, sums array<decimal(38,0)>, d array<double>, u array<double>"

    def row(self, *more):
        from decimal import Decimal

        cells = [*more, self.n, [Decimal(s) for s in self.sums], self.d.tolist(), self.u.ravel().tolist()]
        kinds = [pa.int64()] * (len(more) + 1) + [pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], ["slot"] * len(more) + ["n", "sums", "d", "u"])

    @staticmethod
    def of(n, sums, d, u):
        return Spectrum(len(d), n, [int(s) for s in sums], np.array(d, float), np.array(u, float).reshape(len(d), len(d)))


def _whole(values):
    """Whole-number vectors of an Arrow list column of one length: (which rows take part, their vectors)."""
    c = np.asarray(values, float)
    v = np.floor(SCALE * c)
    ok = (np.isfinite(v) & (np.abs(v) < LARGEST)).all(1)
    return ok, v[ok].astype(np.int64) + OFFSET


def whole_vectors(rows, key="vec_id", vector="embedding"):
    """(key, x) with x the vector as packed long numbers, and the vectors' length.

    Rows whose vector is null, or holds null or non-finite components (or ones beyond 2^52 / 64), are left out. So are
    vectors of another length than the commonest (the smallest of such), since there is no covariance between lengths.
    """
    v = F.col(vector).cast("array<double>")
    clean = rows.select(F.col(key).alias("key"), v.alias("v")).where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    size = clean.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).where("size > 0").orderBy(F.desc("n"), "size").first()
    if size is None:
        return None, 0
    kind = dict(clean.dtypes)["key"]

    def run(batches):
        for b in batches:
            if b.num_rows:
                ok, x = _whole(np.asarray(b.column("v").flatten()).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([b.column("key").filter(pa.array(ok)), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "x"])

    return clean.where(F.size("v") == size["size"]).mapInArrow(run, f"key {kind}, x binary"), size["size"]


def _vectors(column, size):
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, size)


def spectrum(fit, size, fan=FAN):
    """The combined Spectrum of a table of packed vectors ``x``: one row a task, combined ``fan`` at a time in parallel."""

    def local(batches):
        s = Spectrum(size)
        for b in batches:
            for x in _vectors(b.column("x"), size).tolist():
                s.add(x)
        if s.n:
            yield s.row(0)

    def combine(table):
        s = Spectrum(size)
        for r in table.to_pylist():
            s.merge(Spectrum.of(r["n"], r["sums"], r["d"], r["u"]))
        return pa.Table.from_batches([s.row(0)])

    ddl = "slot long, " + Spectrum.COLUMNS
    parts = stage(fit.mapInArrow(local, ddl), "spectra")
    while (left := parts.count()) > fan:
        slots = -(-left // fan)
        dealt = parts.repartition(slots, F.xxhash64("d", "n")).withColumn("slot", F.pmod(F.xxhash64("d", "n"), F.lit(slots)))
        parts = stage(dealt.groupBy("slot").applyInArrow(combine, ddl), "spectra")
    out = Spectrum(size)
    for r in parts.collect():  # at most ``fan`` rows
        out.merge(Spectrum.of(r["n"], r["sums"], r["d"], r["u"]))
    return out


def _cells(table, size, project):
    """The upper triangle, summed over all rows of ``table``, of the products of each row's ``project``ed coordinates."""
    at = np.triu_indices(size)

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                y = project(b)
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at[0]))), pa.array(total[at])], ["cell", "v"])

    out = np.zeros((size, size))
    for r in table.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # size ** 2 / 2 rows
        out[at[0][r[0]], at[1][r[0]]] = r[1]
    return np.triu(out) + np.triu(out, 1).T


class Whitener:
    """Mean, eigenvalues (falling) and components (as columns) of a table's distinct vectors."""

    def __init__(self, size, n, sums, values, components):
        self.size, self.n, self.sums, self.values, self.components = size, n, sums, values, components
        self.trace = float(values.sum())
        self.usable = int((values > max(values.max(initial=0.0), 0.0) * size * 8 * _EPS).sum())

    def scaled(self, x):
        """n * x - sums, as whole numbers."""
        big = max([abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))]) * self.n + max(map(abs, self.sums), default=0)
        return x * self.n - np.array(self.sums, np.int64) if big < 2**62 else x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x):
        return self.scaled(x).astype(float) / self.n

    def deviations(self, x):
        """The sum of squares of ``scaled``, exact; None where a long can't hold it."""
        y = self.scaled(x)
        if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * self.size < 2**62:
            return (y * y).sum(1).tolist()
        sums = [sum(int(v) ** 2 for v in row) for row in y.tolist()]
        return [s if s < 2**63 else None for s in sums]

    def whiten(self, x, k):
        return self.centred(x) @ self.components[:, :k] / np.sqrt(self.values[:k])


def fit(distinct, size, rounds=3):
    """The Whitener of a table of distinct packed vectors ``x``."""
    s = spectrum(distinct, size)
    basis = np.linalg.qr(s.u[:, ::-1])[0]
    w = Whitener(size, s.n, s.sums, np.zeros(size), basis)
    for _ in range(rounds):
        h = _cells(distinct, size, lambda b: w.centred(_vectors(b.column("x"), size)) @ w.components) / s.n
        off = np.abs(h - np.diag(np.diag(h))) / np.sqrt(np.maximum(np.outer(np.diag(h), np.diag(h)), _TINY))
        settled = off.max(initial=0.0) < 1e-9
        values, turn = np.linalg.eigh(h)
        turned = np.linalg.qr(w.components @ turn[:, ::-1])[0]
        sign = np.sign(turned[np.abs(turned).argmax(0), np.arange(size)])
        w = Whitener(size, s.n, s.sums, np.maximum(values[::-1], 0.0), turned * np.where(sign == 0, 1.0, sign))
        if settled:
            break
    return w


def whiten(rows, key="vec_id", vector="embedding", components=16):
    """One row a row of ``rows`` that takes part and a component: key, component (from 1), n, deviation, whitened,
    explained, identity_error. See ``whole_vectors`` for what takes part.

    The fit is over distinct vectors, so repeated rows do not weigh more; each is whitened. Null keys are kept. Components whose
    eigenvalue is zero to rounding have no scale and are left out: equal vectors only, or one, give no rows, as does an
    empty table. ``deviation`` is null where a long can't hold it (beyond about 10^8 vectors of this spread).
    """
    ddl = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    kind = dict(rows.dtypes)[key]
    x, size = whole_vectors(rows, key, vector)
    nothing = rows.sparkSession.createDataFrame([], f"`{key}` {kind}, {ddl}")
    if x is None:
        return nothing
    base = stage(x, "vectors")
    distinct = base.select("x").distinct()
    n = distinct.count()
    if not n:
        return nothing
    parts = max(1, min(n // 64, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS))))
    distinct = stage(distinct.repartition(parts, "x"), "distinct")
    w = fit(distinct, size)
    k = min(components, w.usable)
    if not k:
        return nothing
    error = float(np.abs(_cells(distinct, k, lambda b: w.whiten(_vectors(b.column("x"), size), k)) / w.n - np.eye(k)).max())
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        w = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                v = _vectors(b.column("x"), size)
                m = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("key").take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, w.n)),
                        pa.array(w.deviations(v), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(w.whiten(v, k).ravel()),
                        pa.array(np.tile(w.values[:k] / w.trace, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    [key, *(c.split()[0] for c in ddl.split(", "))],
                )

    return base.mapInArrow(run, f"`{key}` {kind}, {ddl}")


def op11_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
