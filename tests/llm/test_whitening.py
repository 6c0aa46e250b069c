import math

import numpy as np
import pytest

from tidemark.llm import whitening as W

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(x):
    """n, sums, eigenvalues (falling), vectors of the distinct rows of ``x`` by a dense eigensolver."""
    u = np.unique(x, axis=0)
    c = u - u.sum(0) / len(u)
    e, v = np.linalg.eigh(c.T @ c / len(u))
    return len(u), u.sum(0), e[::-1], v[:, ::-1]


def compare(got, ids, x, components=4):
    n, sums, e, v = plain(x)
    k = sum(e[:components] > 1e-12 * e[0])
    assert len(got) == k * len(x)
    at = {}
    for r in got:
        at.setdefault((r.vec_id, r.component), []).append(r)
    for c in range(1, k + 1):
        want = (x - sums / n) @ v[:, c - 1] / math.sqrt(e[c - 1])
        have = np.array([at[i, c][0].whitened for i in ids])
        sign = np.sign(have @ want)
        assert np.abs(have * sign - want).max() < 1e-8
        for i, row in zip(ids, x, strict=True):
            r = at[i, c][0]
            assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True))
            assert abs(r.explained - e[c - 1] / e.sum()) <= 1e-9 and r.identity_error < 1e-9


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.floor(256 * np.array([r.embedding for r in rows]))
    compare(W.op13_whitening(spark, SF).collect(), [r.vec_id for r in rows], x)


@pytest.mark.parametrize("parts", [1, 7])
def test_odd_rows(spark, parts):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 5)).round(2)
    x[40:] = x[0]  # a large group of copies
    x[:, 4] = x[:, 3]  # no rank of its own
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(100, None, 1), (101, [1.0, None, 1.0, 1.0, 1.0], 1), (102, [float("nan")] * 5, 1), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1), (104, [1.0, 2.0], 1), (105, [], 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(parts)
    got = W.whitened(df).collect()
    assert {g.vec_id for g in got} == set(range(60))
    compare(got, range(60), np.floor(256 * np.array(x, np.float32).astype(float)))


def test_degenerate_tables(spark):
    one = [(i, [0.5, 0.25], 0) for i in range(9)]
    assert W.whitened(spark.createDataFrame(one, SCHEMA)).count() == 0
    assert W.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    two = spark.createDataFrame([*one, (9, [0.25, 0.25], 0), (9, [0.25, 0.25], 0)], SCHEMA)
    got = W.whitened(two).collect()
    assert len(got) == 11 and all(abs(abs(g.whitened) - 1) < 1e-12 and g.explained == 1 and g.component == 1 for g in got)
    far = spark.createDataFrame([(0, [3e38, 1.0], 0), (1, [-3e38, 2.0], 0)], SCHEMA)
    assert all(g.deviation is None and math.isfinite(g.whitened) for g in W.whitened(far).collect())


def test_updates_keep_the_spectrum():
    r = np.random.default_rng(0)
    for x in (r.normal(size=(200, 12)), r.integers(-2, 3, (300, 6)).astype(float), np.repeat(np.eye(5) * 9, 4, 0), np.ones((5, 3)), np.linspace(0, 1, 40)[:, None] * np.ones(8)):
        d = x.shape[1]
        parts = []
        for piece in np.array_split(x, 3):
            n, mean, lam, q = 0, np.zeros(d), np.zeros(d), np.eye(d)
            for v in piece:
                step = v - mean
                if n:
                    lam, q = W.rank_one(lam, q, step, n / (n + 1))
                n += 1
                mean = mean + step / n
            parts.append((n, mean, lam, q))
        n, mean, lam, q = W.merged(W.merged(parts[0], parts[1]), parts[2])
        c = x - x.mean(0)
        assert n == len(x) and np.allclose(mean, x.mean(0))
        assert np.abs(q.T @ q - np.eye(d)).max() < 1e-12
        assert np.abs(q @ np.diag(lam) @ q.T - c.T @ c).max() < 1e-11 * max(1, np.abs(c.T @ c).max())
