"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Candidates are sorted by label and by their place on a Hilbert curve through all dimensions, and cut into blocks of one label, stored as
Parquet. The zone map of a block is the least and greatest value of each dimension; interval arithmetic bounds the inner product of an
anchor with anything in the block from both sides. Anchors, in curve order too, ask in batches, in two searches of the same form: for the best rows
of their own label (the positives), then for the best rows of other labels in a window of scores below each positive. A search first reads, for each
anchor, the block with the highest bound; its results give each window a floor. Then it reads every other block whose bounds
reach over the floor and into the window, and no more: a block left out can't hold a result. Scores are exact whole numbers.

How many blocks that spares depends on the data: boxes around unrelated vectors of many dimensions are wide. ``plan`` tells what a search reads.

Defined results: rows whose vec_id, label or vector is null, or whose vector holds null or non-finite entries, take no part; nor do vectors of another
length than the most frequent one. Of rows that share a vec_id the one with the smallest label, then vector, takes part. Ties go to the smaller vec_id. An anchor
without positives, and a positive without negatives in its window, give no rows; a window below a negative score is empty. An empty table gives no rows. Scores
beyond a long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.whitening import quantised

#: Bits of the curve in each dimension; most rows of a block, of a batch of anchors, and zone maps in a row of their table.
BITS, BLOCK, BATCH, PACK = 4, 512, 256, 512
POSITIVES, NEGATIVES = 5, 10
#: The window in hundredths of the positive's score.
LOW, HIGH = 30, 90
FAR = 1 << 62
#: Result rows that a task holds before it drops those that can't be among the first any more.
HELD = 200_000


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve through cells (rows) of ``bits`` bits a dimension, as bytes that sort in curve order."""
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the turns of the curve, from the coarsest bit on
        low = np.uint64((1 << b) - 1)
        for i in range(dims):
            turned = (x[i] >> np.uint64(b)) & one == 1
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[-1] >> np.uint64(b)) & one == 1, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= t
    planes = np.stack([(x >> np.uint64(b)) & one for b in range(bits - 1, -1, -1)])  # bit, dimension, row
    return np.packbits(planes.reshape(bits * dims, -1).astype(np.uint8).T, axis=1)


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def with_place(rows: DataFrame, d: int) -> DataFrame:
    """``rows`` (vec_id, label, x) with ``place`` on the curve. Cells span all values of the table."""
    span = rows.agg(F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi")).first()
    lo, wide = span["lo"] or 0, (span["hi"] or 0) - (span["lo"] or 0) + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), d)
            cells = np.clip((x - lo) * float(1 << BITS) / wide, 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p.tobytes() for p in hilbert(cells)], pa.binary())], names=[*b.schema.names, "place"])

    return rows.select("vec_id", F.col("label").cast("long").alias("label"), "x").mapInArrow(of, "vec_id bigint, label bigint, x array<bigint>, place binary")


def blocks(placed: DataFrame, d: int, most: int = BLOCK) -> DataFrame:
    """(block, part, label, ids, x, lo, hi): rows in curve order, label by label. ``part`` is the partition, a folder of the stored table."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, x, label = np.zeros(0, np.int64), np.zeros((0, d), np.int64), None

        def cut(at: int) -> pa.RecordBatch:
            nonlocal ids, x, made
            take, v = ids[:at], x[:at]
            ids, x, made = ids[at:], x[at:], made + 1
            order = np.argsort(take, kind="stable")
            data = {"block": (part << 32) + made, "part": part, "label": int(label), "ids": take[order].tolist(), "x": v[order].ravel().tolist(), "lo": v.min(0).tolist(), "hi": v.max(0).tolist()}
            return pa.RecordBatch.from_pylist([data], schema)

        for b in batches:
            labels, fresh, more = b.column(1).to_numpy(), b.column(0).to_numpy(), _matrix(b.column(2), d)
            edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if len(ids) and labels[i] != label:
                    yield cut(len(ids))
                label, ids, x = labels[i], np.concatenate([ids, fresh[i:j]]), np.concatenate([x, more[i:j]])
                while len(ids) >= most:
                    yield cut(most)
        if len(ids):
            yield cut(len(ids))

    longs = pa.list_(pa.int64())
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("label", pa.int64()), ("ids", longs), ("x", longs), ("lo", longs), ("hi", longs)])
    ordered = placed.repartitionByRange("label", "place", "vec_id").sortWithinPartitions("label", "place", "vec_id").select("vec_id", "label", "x")
    return ordered.mapInArrow(of, "block bigint, part int, label bigint, ids array<bigint>, x array<bigint>, lo array<bigint>, hi array<bigint>")


def packed(table: DataFrame, most: int = PACK) -> DataFrame:
    """(pack, zones): zone maps, so many in a row."""
    zone = F.struct("block", "part", "label", "lo", "hi")
    ordered = table.select("block", "part", "label", "lo", "hi").repartitionByRange("label", "block").sortWithinPartitions("label", "block").withColumn("n", F.monotonically_increasing_id())
    return ordered.groupBy(F.expr(f"n div {most}").alias("pack")).agg(F.collect_list(zone).alias("zones"))


def batched(anchors: DataFrame) -> DataFrame:
    """(batch, a): at most ``BATCH`` anchors (vec_id, label, x, low, high, floor, seen), in the order of ``at``."""
    one = F.struct("at", "vec_id", "label", "x", "low", "high", "floor", "seen")
    return anchors.groupBy("batch").agg(F.array_sort(F.collect_list(one)).alias("a"))


class Asked:
    """A batch as arrays."""

    def __init__(self, column, i: int, d: int):
        a = column.slice(i, 1).flatten()
        get = lambda f: a.field(f).to_numpy(zero_copy_only=False)
        self.ids, self.labels, self.seen = get("vec_id"), get("label"), get("seen")
        self.x = _matrix(a.field("x"), d)
        self.low, self.high, self.floor = (_matrix(a.field(f), a.field(f).value_lengths()[0].as_py()) for f in ("low", "high", "floor"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, int64. Doubles are exact below 2^53; beyond, whole numbers of any size."""
    if not a.size or not b.size or int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``a`` with anything in each box, rounding allowed for."""
    up, down, lo, hi = np.maximum(a, 0).astype(float), np.minimum(a, 0).astype(float), lo.astype(float), hi.astype(float)
    slack = 1e-12 * (np.abs(a).astype(float) @ np.maximum(np.abs(lo), np.abs(hi)).T) + 1e-9
    return up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack


def _reach(q: Asked, zones, d: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(which anchor may find a result in which box, upper bounds)."""
    lo, hi, labels = _matrix(zones.field("lo"), d), _matrix(zones.field("hi"), d), zones.field("label").to_numpy()
    least, most = bounds(q.x, lo, hi)
    ok = (labels[None, :] == q.labels[:, None]) == same
    some = np.zeros_like(ok)
    for w in range(q.low.shape[1]):
        some |= (most >= np.maximum(q.low[:, w], q.floor[:, w])[:, None]) & (least <= q.high[:, w][:, None]) & (q.low[:, w] <= q.high[:, w])[:, None]
    return ok & some, most


def _met(batches_: DataFrame, packs: DataFrame, same: bool) -> DataFrame:
    """Every batch with every row of zone maps: the stated anchors against all blocks. The maps are salted, so that neither side's rows meet on one key."""
    salts = 64
    left = batches_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(packs.withColumn("salt", F.pmod(F.xxhash64("pack"), F.lit(salts)).cast("int")), "salt").select("batch", "a", "zones")


def highest(batches_: DataFrame, packs: DataFrame, d: int, same: bool) -> DataFrame:
    """(vec_id, first): of each anchor the block with the highest bound."""

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(b.num_rows):
                q, zones = Asked(b.column(1), i, d), b.column(2).slice(i, 1).flatten()
                ok, most = _reach(q, zones, d, same)
                most = np.where(ok, most, -np.inf)
                at = most.argmax(1)
                some = ok.any(1)
                yield pa.record_batch([pa.array(q.ids[some]), pa.array(most.max(1)[some]), pa.array(zones.field("block").to_numpy()[at[some]])], names=["vec_id", "bound", "block"])

    return _met(batches_, packs, same).mapInArrow(of, "vec_id bigint, bound double, block bigint").groupBy("vec_id").agg(F.max_by("block", F.struct("bound", "block")).alias("first"))


def plan(batches_: DataFrame, packs: DataFrame, d: int, same: bool, first: bool) -> DataFrame:
    """(batch, block, part, who): the blocks that anchors of a batch must read, ``who`` a bit for each. ``first``: only the block in ``seen``; else all others."""

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(b.num_rows):
                q, zones = Asked(b.column(1), i, d), b.column(2).slice(i, 1).flatten()
                ok, _ = _reach(q, zones, d, same)
                block = zones.field("block").to_numpy()
                ok &= (block[None, :] == q.seen[:, None]) == first
                at = np.flatnonzero(ok.any(0))
                bits = np.packbits(ok[:, at].T, axis=1)
                yield pa.record_batch([pa.array(np.full(len(at), b.column(0)[i].as_py()), pa.int64()), pa.array(block[at]), pa.array(zones.field("part").to_numpy()[at]), pa.array([w.tobytes() for w in bits], pa.binary())], names=["batch", "block", "part", "who"])

    return _met(batches_, packs, same).mapInArrow(of, "batch bigint, block bigint, part int, who binary")


FOUND = "vec_id bigint, w int, found bigint, score bigint"


def best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each window, with ``rank``."""
    w = Window.partitionBy("vec_id", "w").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scored(wanted: DataFrame, batches_: DataFrame, table: DataFrame, d: int, k: int) -> DataFrame:
    """``FOUND``: the first rows of each window in each task's blocks, ``k`` at most."""

    def kept(held: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 3], rows[:, 1], rows[:, 0]))]
        start = np.append(True, (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0))
        at = np.arange(len(rows))
        return rows[at - np.maximum.accumulate(np.where(start, at, 0)) < k]

    def send(rows: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2]), pa.array(rows[:, 3])], names=["vec_id", "w", "found", "score"])

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in rows:
            for i in range(b.num_rows):
                q = Asked(b.column(0), i, d)
                who = np.flatnonzero(np.unpackbits(np.frombuffer(b.column(1)[i].as_py(), np.uint8))[: len(q.ids)])
                ids = b.column(2).slice(i, 1).flatten().to_numpy()
                s = products(q.x[who], _matrix(b.column(3).slice(i, 1), d))
                other = q.ids[who][:, None] != ids[None, :]
                for w in range(q.low.shape[1]):
                    ok = other & (s >= np.maximum(q.low[who, w], q.floor[who, w])[:, None]) & (s <= q.high[who, w][:, None])
                    if not ok.any():
                        continue
                    # ids rise along a block: a stable sort by falling score breaks ties by id
                    order = np.argsort(np.where(ok, -s, FAR), axis=1, kind="stable")[:, :k]
                    r, c = np.nonzero(np.take_along_axis(ok, order, 1))
                    col = order[r, c]
                    held.append(np.stack([q.ids[who[r]], np.full(len(r), w), ids[col], s[r, col]], axis=1))
                    n += len(r)
                if n > HELD:
                    held = [kept(held)]
                    n = len(held[0])
                    if n > HELD // 2:
                        yield send(held[0])
                        held, n = [], 0
        if n:
            yield send(kept(held))

    met = wanted.join(batches_, "batch").join(table.select("block", "ids", "x"), "block").select("a", "who", "ids", "x")
    return met.mapInArrow(of, FOUND)


def _read(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored table's folders that hold a wanted block. There are as many as partitions, however many rows."""
    parts = [r["part"] for r in wanted.select("part").distinct().collect()]
    return table.where(F.col("part").isin(parts)) if parts else table.limit(0)


def search(anchors: DataFrame, table: DataFrame, packs: DataFrame, d: int, k: int, same: bool) -> DataFrame:
    """(vec_id, w, found, score, rank): the first ``k`` rows of each window of each anchor.

    ``anchors``: (batch, at, vec_id, label, x, low, high), one entry of ``low`` and ``high`` a window, as many for all. ``same``: of the anchor's label, else of all others.
    """
    none = F.transform("low", lambda _: F.lit(-FAR))
    start = stored(batched(anchors.withColumns({"floor": none, "seen": F.lit(-1).cast("long")})), "negatives-batches")
    seeds = stored(highest(start, packs, d, same), "negatives-seeds")
    begun = stored(batched(anchors.withColumn("floor", none).join(seeds, "vec_id", "left").withColumn("seen", F.coalesce("first", F.lit(-1).cast("long"))).drop("first")), "negatives-batches")
    wanted = stored(plan(begun, packs, d, same, True), "negatives-plan")
    early = stored(scored(wanted, begun, _read(table, wanted), d, k), "negatives-found")
    # a window with k results needs nothing below the last of them
    full = best(early, k).where(F.col("rank") == k).groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("floors"))
    at = F.transform("low", lambda x, w: F.coalesce(F.try_element_at("floors", w.cast("int")), F.lit(-FAR)))
    raised = anchors.join(full, "vec_id", "left").withColumn("floor", F.when(F.col("floors").isNull(), none).otherwise(at)).drop("floors")
    going = stored(batched(raised.join(seeds, "vec_id", "left").withColumn("seen", F.coalesce("first", F.lit(-1).cast("long"))).drop("first")), "negatives-batches")
    wanted = stored(plan(going, packs, d, same, False), "negatives-plan")
    late = scored(wanted, going, _read(table, wanted), d, k)
    return best(early.unionByName(late), k)


def hard_negatives(rows: DataFrame, is_anchor: Column, d: int, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``rows``: (vec_id, label, x) without nulls, vectors of ``d`` entries."""
    spark = rows.sparkSession
    rows = rows.select("vec_id", F.col("label").cast("long").alias("label"), "x").where("vec_id is not null and label is not null")
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
    placed = stored(with_place(rows, d), "negatives-placed")
    path = stored(blocks(placed, d, block), "negatives-blocks")
    packs = stored(packed(path), "negatives-zones")
    mine = placed.where(is_anchor).repartitionByRange("label", "place", "vec_id").sortWithinPartitions("label", "place", "vec_id").withColumn("n", F.monotonically_increasing_id())
    every = F.array(F.lit(FAR))
    anchors = stored(mine.select(F.expr(f"n div {BATCH}").alias("batch"), F.expr(f"n % {BATCH}").alias("at"), "vec_id", "label", "x", F.transform(every, lambda v: -v).alias("low"), every.alias("high")), "negatives-anchors")
    near = stored(search(anchors, path, packs, d, positives, True), "negatives-positives")
    score = F.col("score").cast("decimal(38,0)")
    p = near.select("vec_id", "rank", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"), F.ceil(score * low / 100).cast("long").alias("l"), F.floor(score * high / 100).cast("long").alias("h"))
    by_rank = p.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct("l", "h").alias("v")))).alias("p"))
    # windows that an anchor lacks are empty
    of = lambda f, none: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at("p", i)[f], F.lit(none)))
    asking = stored(anchors.drop("low", "high").join(by_rank, "vec_id").withColumns({"low": of("l", FAR), "high": of("h", -FAR)}).drop("p"), "negatives-asking")
    found = search(asking, path, packs, d, negatives, False)
    out = found.withColumn("pos", F.col("w") + 1).join(p.select("vec_id", F.col("rank").alias("pos"), "positive_id", "positive_score"), ["vec_id", "pos"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def op11_negatives(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null and vec_id is not null")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows, d = quantised(table.withColumn("label", label), keep=("vec_id", "label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, d) if d else spark.createDataFrame([], OUT)
