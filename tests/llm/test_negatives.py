import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives as N

SF = "/root/testdata/sf0.001"


def plain(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """rows: (vec_id, label, whole-number vector), one for each vec_id."""
    out = set()
    x = np.array([r[2] for r in rows], object)
    for a, la, v in rows:
        if not is_anchor(a):
            continue
        s = x @ np.array(v, object)
        rank = sorted(range(len(rows)), key=lambda i: (-s[i], rows[i][0]))
        for p in [i for i in rank if rows[i][1] == la and rows[i][0] != a][:positives]:
            fit = [i for i in rank if rows[i][1] != la and low * s[p] <= 100 * s[i] <= high * s[p]]
            out |= {(a, rows[p][0], k + 1, rows[i][0], s[p], s[i]) for k, i in enumerate(fit[:negatives])}
    return out


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(v) for v in np.floor(256 * np.array(r.embedding))]) for r in table]
    got = N.op11_negatives(spark, SF).collect()
    want = plain(rows, lambda i: i % 100 == 0)
    assert len(got) == len(want) and set(map(tuple, got)) == want and want


@pytest.mark.parametrize("seed", [0, 1])
def test_clusters_and_ties(spark, seed):
    """Blocks of a few rows: most are spared, and ties, copies and hot labels keep their order."""
    r = np.random.default_rng(seed)
    centres = r.integers(-60, 60, (6, 4))
    rows = []
    for i in range(400):
        label = 0 if i % 3 else int(r.integers(1, 5))
        v = centres[i % 6] + r.integers(-2, 3, 4) if i % 5 else centres[0]
        rows.append((i, label, [int(c) for c in v]))
    df = spark.createDataFrame(rows, "vec_id long, label int, x array<bigint>")
    got = N.hard_negatives(df, F.col("vec_id") % 10 == 0, 4, block=16).collect()
    want = plain(rows, lambda i: i % 10 == 0)
    assert len(got) == len(want) and set(map(tuple, got)) == want and len(want) > 100


def test_plan_spares_blocks(spark):
    r = np.random.default_rng(2)
    rows = [(i, i % 2, [int(c) for c in np.eye(8)[i % 8] * 200 + r.integers(0, 3, 8)]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, label int, x array<bigint>")
    placed = N.with_place(df, 8).cache()
    table = N.blocks(placed, 8, 20).cache()
    packs = N.packed(table)
    anchors = placed.where("vec_id = 0").select(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("at"), "vec_id", "label", "x", F.array(F.lit(30_000)).alias("low"), F.array(F.lit(50_000)).alias("high"), F.array(F.lit(-N.FAR)).alias("floor"), F.lit(-1).cast("long").alias("seen"))
    read = N.plan(N.batched(anchors), packs, 8, True, False).count()
    assert 0 < read <= table.where("label = 0").count() / 2


def test_curve_is_continuous():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = [bytes(k) for k in N.hilbert(cells, 3)]
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert len(set(keys)) == 512 and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_odd_rows(spark, tmp_path):
    big = 1 << 52
    rows = [(0, 1, [big, big]), (1, 1, [big, big]), (2, 2, [big, 0]), (3, 2, [1, 1]), (4, 1, [-1, -1])]
    df = spark.createDataFrame(rows, "vec_id long, label int, x array<bigint>")
    got = {tuple(r) for r in N.hard_negatives(df, F.col("vec_id") < 2, 2).collect()}
    top = (1 << 63) - 1
    assert got == set() or all(r[4] <= top for r in got)
    twice = spark.createDataFrame([(0, 1, [9, 9]), (0, 1, [9, 9]), (0, 2, [1, 1]), (1, 1, [8, 8]), (2, 3, [4, 4])], "vec_id long, label int, x array<bigint>")
    assert [tuple(r) for r in N.hard_negatives(twice, F.col("vec_id") == 0, 2).collect()] == [(0, 1, 1, 2, 144, 72)]
    table = [(0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.25, 0.25], 2), (3, None, 2), (4, [None, 1.0], 2), (5, [float("nan"), 1.0], 2), (6, [0.2, 0.2], None), (None, [0.2, 0.2], 2), (8, [0.2], 2)]
    folder = str(tmp_path)
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame(table, schema).write.parquet(f"{folder}/embeddings.parquet")
    out = [tuple(r) for r in N.op11_negatives(spark, folder).collect()]
    assert out == []  # vec_id 0 becomes label 2: its one positive scores less than all negatives
    spark.createDataFrame([(100, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.25, 0.25], 2)], schema).write.parquet(f"{folder}/b/embeddings.parquet")
    assert [tuple(r) for r in N.op11_negatives(spark, f"{folder}/b").collect()] == [(100, 1, 1, 2, 32768, 16384)]
    spark.createDataFrame([], schema).write.parquet(f"{folder}/c/embeddings.parquet")
    assert N.op11_negatives(spark, f"{folder}/c").count() == 0
