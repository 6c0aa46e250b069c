"""Embedding whitening by an incremental eigendecomposition.

Each partition holds the mean and the spectrum (eigenvalues and vectors of the centred scatter) of the vectors it has read. A vector changes the
scatter by one centred rank-one update: the new eigenvalues are the roots of a secular equation, after components that the update
can't reach have been deflated, and the new vectors follow from the roots. Spectra of partitions are combined in a tree by
successive rank-one updates, one for each component of the other spectrum and one for the difference of the means; nothing but
spectra, of a size that the dimension bounds, is ever moved. What rounding has left is removed by a final distributed Rayleigh-Ritz step: the covariance is projected
on the found basis, over all vectors, and its small eigenproblem turns the basis.

Sums, counts and deviations are exact whole numbers; covariances are over distinct vectors, so a group of copies counts once.

Defined results: rows whose vector is null or holds null or non-finite entries give no rows; nor do vectors of another length than the most frequent one (of equally
frequent lengths the longest). A null vec_id is kept. Repeated rows each have theirs. Scaled entries beyond 2^53 are held there. A deviation that doesn't fit a long is null. A component whose
eigenvalue isn't above rounding (1e-12 of the largest) can't be whitened: it is left out, so a table of one distinct vector, or an empty one, gives no rows. Vectors
with fewer than four entries give as many components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, stored

SCALE, COMPONENTS = 256, 4
EDGE = 1 << 53
#: Spectra that are combined at once.
FAN_IN = 8
EPS = np.finfo(float).eps
SPECTRUM = "n bigint, mean array<double>, lam array<double>, q array<double>, sums array<decimal(38,0)>"


def roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum z2 / (d - x) for distinct rising ``d`` and positive ``z2``, ``rho``: (index of the nearest pole, distance to it).

    All roots at once; each lies between two poles, the last beyond the last one. The two sums, of the poles on either side, are replaced by a pole each that has their value and
    slope, and the quadratic that remains is solved; a step that leaves its bracket is halved instead.
    """
    k, top = len(d), rho * z2.sum()
    right = np.append(d[1:], d[-1] + top)
    middle = (right - d) / 2
    gap = d[None, :] - d[:, None]  # gap[i, j]: pole j seen from pole i
    f = 1 + rho * (z2 / (gap - middle[:, None])).sum(1)
    near = np.where(f > 0, np.arange(k), np.arange(k) + 1)
    near[-1] = k - 1
    seen = d[None, :] - d[near][:, None]  # poles, from each root's nearest
    low = np.where(near == np.arange(k), 0.0, d - d[near])
    high = np.where(near == np.arange(k), right - d[near], 0.0)
    inner = d + middle - d[near]
    low, high = np.where(f > 0, low, np.maximum(low, inner)), np.where(f > 0, np.minimum(high, inner), high)
    x = (low + high) / 2
    low, high, weights = low.copy(), high.copy(), rho * z2
    below = np.tri(k, dtype=bool)
    here = np.arange(k)  # roots that are still moving
    for _ in range(80):
        t, i = x[here], here
        final = i == k - 1
        part = weights / (seen[i] - t[:, None])
        slope = part / (seen[i] - t[:, None])
        value = 1 + part.sum(1)
        lo, hi = np.where(value < 0, t, low[i]), np.where(value > 0, t, high[i])
        low[i], high[i] = lo, hi
        before = below[i]
        psi, dpsi = (part * before).sum(1), (slope * before).sum(1)
        phi, dphi = value - 1 - psi, slope.sum(1) - dpsi
        dl, dr = seen[i, i] - t, np.where(final, 1.0, seen[i, np.minimum(i + 1, k - 1)] - t)
        r, s = dpsi * dl**2, np.where(final, 0.0, dphi * dr**2)
        c = 1 + psi - dpsi * dl + np.where(final, 0.0, phi - dphi * dr)
        # c + r / (dl - step) + s / (dr - step) = 0
        a1, a0 = -(c * (dl + dr) + r + s), c * dl * dr + r * dr + s * dl
        tiny = 16 * EPS * np.abs(t)
        fits = lambda step: np.isfinite(step) & (t + step != 0) & ((t + step >= lo) & (t + step <= hi) | (np.abs(step) <= tiny))  # noqa: E731, B023
        with np.errstate(all="ignore"):
            h = -(a1 + np.where(a1 >= 0, 1.0, -1.0) * np.sqrt(np.maximum(a1 * a1 - 4 * c * a0, 0))) / 2
            one, two, only = h / c, a0 / h, dl + r / c
        half = (lo + hi) / 2 - t
        step = np.where(final, np.where(fits(only), only, half), np.where(fits(two), two, np.where(fits(one), one, half)))
        x[i] = t + step
        going = (np.abs(step) > tiny) & (hi - lo > 2 * EPS * np.maximum(np.abs(lo), np.abs(hi))) & (value != 0)
        here = i[going]
        if not len(here):
            break
    return near, x


def rank_one(lam: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (rising eigenvalues, vectors as columns) of q diag(lam) q' + rho v v', rho at least 0."""
    z = q.T @ v
    size = rho * (z @ z)
    if not size > 0:
        return lam, q
    scale = max(np.abs(lam).max(), size)
    # equal eigenvalues: their vectors are turned so that the update reaches one of them
    tie = np.flatnonzero(np.diff(lam) <= 8 * EPS * scale)
    if len(tie):
        q, z = q.copy(), z.copy()
        for i in tie:
            r = np.hypot(z[i], z[i + 1])
            if r > 0:
                c, s = z[i + 1] / r, z[i] / r
                q[:, [i, i + 1]] = q[:, [i, i + 1]] @ np.array([[c, s], [-s, c]])
                z[i], z[i + 1] = 0.0, r
    moved = rho * np.abs(z) * np.linalg.norm(z) > 8 * EPS * scale
    moved[tie] = False
    k = int(moved.sum())
    if not k:
        return lam, q
    d, zz = lam[moved], z[moved]
    near, x = roots(d, zz * zz, rho)
    away = (d[None, :] - d[near][:, None]) - x[:, None]  # away[i, j] = d[j] - root i
    # weights that make the roots exact: the vectors are then orthogonal to rounding
    num, den = -away, d[:, None] - d[None, :]
    den[np.arange(k), np.arange(k)] = 1.0
    ratio = num / np.where(np.eye(k, dtype=bool), 1.0, den)  # ratio[i, j] = (root i - d[j]) / (d[i] - d[j])
    w = np.sqrt(np.abs(ratio.prod(0))) * np.where(zz < 0, -1.0, 1.0)
    vectors = w[:, None] / away.T
    vectors /= np.linalg.norm(vectors, axis=0)
    out, basis = lam.copy(), q.copy()
    out[moved] = d[near] + x
    basis[:, moved] = q[:, moved] @ vectors
    order = np.argsort(out, kind="stable")
    return out[order], basis[:, order]


def merged(a: tuple, b: tuple) -> tuple:
    """(n, mean, eigenvalues, vectors) of two sets of vectors together: successive rank-one updates of the first by the components of the second, then by the means' difference."""
    (n, mean, lam, q), (m, other, mu, p) = a, b
    if not n or not m:
        return b if not n else a
    for i in np.flatnonzero(mu > 0):
        lam, q = rank_one(lam, q, p[:, i], float(mu[i]))
    step = other - mean
    lam, q = rank_one(lam, q, step, n * m / (n + m))
    return n + m, mean + step * (m / (n + m)), lam, q


def _arrays(row: dict) -> tuple:
    d = len(row["mean"])
    return row["n"], np.array(row["mean"]), np.array(row["lam"]), np.array(row["q"]).reshape(d, d)


def _row(n: int, mean, lam, q, sums) -> dict:
    return {"n": n, "mean": mean.tolist(), "lam": lam.tolist(), "q": q.ravel().tolist(), "sums": [int(x) for x in sums]}


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def quantised(embeddings: DataFrame, scale: int = SCALE, keep: tuple[str, ...] = ("vec_id",)) -> tuple[DataFrame, int]:
    """((kept columns, x array<bigint>) of the rows that take part, their length)."""
    e = F.col("embedding")
    ok = e.isNotNull() & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(e) > 0)
    rows = embeddings.where(F.coalesce(ok, F.lit(False)))
    sizes = rows.groupBy(F.size(e).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    edge = float(EDGE)
    x = F.transform(e, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-edge)), F.lit(edge))))
    return rows.where(F.size(e) == d).select(*keep, x.alias("x")), d


def spectra(fit: DataFrame, d: int) -> DataFrame:
    """One spectrum (``SPECTRUM``) for each partition of ``fit`` (x array<bigint>)."""
    schema = pa.schema([("n", pa.int64()), *((c, pa.list_(pa.float64())) for c in ("mean", "lam", "q")), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, lam, q, sums = 0, np.zeros(d), np.zeros(d), np.eye(d), [0] * d
        for b in batches:
            x = _matrix(b.column(0), d)
            if len(x):
                near = int(np.abs(x).max()) < EDGE // 1024
                sums = [s + int(t) for s, t in zip(sums, x.sum(0) if near else x.astype(object).sum(0), strict=True)]
            for v in x.astype(float):
                step = v - mean
                if n:
                    lam, q = rank_one(lam, q, step, n / (n + 1))
                n += 1
                mean = mean + step / n
        if n:
            yield pa.RecordBatch.from_pylist([_row(n, mean, lam, q, sums)], schema)

    return fit.mapInArrow(of, SPECTRUM)


def combined(parts: DataFrame, d: int, fan_in: int = FAN_IN) -> dict | None:
    """The spectrum of all: partitions' spectra meet in groups of ``fan_in``, level by level, each level stored. The driver gets the last one only."""
    schema = pa.schema([("n", pa.int64()), *((c, pa.list_(pa.float64())) for c in ("mean", "lam", "q")), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def meet(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["n"], r["mean"]))
        out, sums = _arrays(rows[0]), rows[0]["sums"]
        for r in rows[1:]:
            out, sums = merged(out, _arrays(r)), [a + b for a, b in zip(sums, r["sums"], strict=True)]
        return pa.Table.from_pylist([_row(*out, sums)], schema)

    level = stored(parts.withColumn("at", F.monotonically_increasing_id()), "spectra")
    while (n := level.count()) > 1:
        groups = -(-n // fan_in)
        ranked = level.select("*", F.pmod(F.xxhash64("at"), F.lit(groups)).alias("g"))
        after = stored(ranked.drop("at").groupBy("g").applyInArrow(lambda t: meet(t.drop(["g"])), SPECTRUM).withColumn("at", F.monotonically_increasing_id()), "spectra")
        dropped(level)
        level = after
    found = level.first()
    dropped(level)
    return None if found is None else found.asDict()


def gram(fit: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """basis' V basis over ``fit``: V is the covariance, divisor n. A partition sends the entries of one matrix."""
    d, k = basis.shape
    shift, rest = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            y = ((_matrix(b.column(0), d) - shift).astype(float) - rest) @ basis
            total += y.T @ y
        yield pa.record_batch([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["h"])

    parts = fit.mapInArrow(of, "h array<double>")
    summed = parts.select(F.posexplode("h").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # k * k numbers
    out = np.zeros(k * k)
    for r in summed:
        out[r["i"]] = r["v"]
    out = out.reshape(k, k) / n
    return (out + out.T) / 2


def fitted(fit: DataFrame, d: int, components: int = COMPONENTS) -> dict | None:
    """n, sums, and ``matrix``, ``explained``, ``identity_error`` of the whitening components; None without any."""
    model = combined(spectra(fit, d), d)
    if model is None or model["n"] < 2:
        return None
    n, sums = model["n"], [int(s) for s in model["sums"]]
    basis, _ = np.linalg.qr(np.array(model["q"]).reshape(d, d))
    h = gram(fit, n, sums, basis)
    e, turn = np.linalg.eigh(h)
    order = np.argsort(-e)[:components]
    order = order[e[order] > 1e-12 * max(e.max(), 0)]
    if not len(order):
        return None
    vectors = basis @ turn[:, order]
    vectors /= np.linalg.norm(vectors, axis=0)
    matrix = vectors / np.sqrt(e[order])
    error = np.abs(gram(fit, n, sums, matrix) - np.eye(len(order))).max()
    return {"n": n, "sums": sums, "matrix": matrix, "explained": (e[order] / np.trace(h)).tolist(), "identity_error": float(error)}


OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """See ``OUT``: a row for each vector that takes part and component."""
    rows, d = quantised(embeddings, scale)
    spark = embeddings.sparkSession
    # copies are counted once; the partial step before the exchange takes most of a large group
    fit = stored(rows.select("x").distinct(), "whiten-fit")
    model = fitted(fit, d, components) if d else None
    if model is None:
        return spark.createDataFrame([], OUT)
    n, sums, matrix, k = model["n"], model["sums"], model["matrix"], model["matrix"].shape[1]
    shift, rest = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])
    whole = np.array(sums, object)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), d)
            if not len(x):
                continue
            w = ((x - shift).astype(float) - rest) @ matrix
            most = max(n * int(np.abs(x).max()), max(abs(s) for s in sums)) * 2
            if most * most * d < 1 << 63:
                deviation = ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
            else:
                deviation = [t if t < 1 << 63 else None for t in ((n * x.astype(object) - whole) ** 2).sum(1)]
            each = lambda v, kind: pa.array(v, kind).take(pa.array(np.repeat(np.arange(len(x)), k)))
            m = len(x) * k
            yield pa.record_batch(
                [b.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(m, n), pa.int64()), each(deviation, pa.int64()), pa.array(w.ravel()), pa.array(np.tile(model["explained"], len(x))), pa.array(np.full(m, model["identity_error"]))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(of, OUT)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
