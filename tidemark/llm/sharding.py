"""Sharding: a reproducible shuffle with computable shard and slot.

Every row gets a dense global row number; a Feistel permutation with cycle walking
maps it to a place in the shuffle; ``shard = place % shards`` and
``slot = place div shards``. Shards therefore differ by one row at most and slots have
no gaps. ``place_of`` and ``row_of`` compute either direction without any lookup.

Row numbers: rows are dealt to hash buckets of (doc_id, CRC-32, size), numbered inside
each bucket, and shifted by the counts of the buckets before. Equal rows are numbered as one group with a count and unfolded afterwards in
chunks, so that even a row that fills a third of the table meets no single task.

Defined results: null text has size 8 and the CRC of no bytes (0); empty text likewise; null
doc_id is an ordinary value; equal rows take as many places as they are rows; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import aside, stored

ROUNDS = 6
#: Rows of one group of equal rows that one task unfolds at a time.
CHUNK = 1 << 16
#: Cycle-walking steps tried before the walk of guaranteed length.
FIRST_STEPS = 8


def _sides(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square with a * b >= n: under a places lie beyond n."""
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def _div(x: Column, n: int) -> Column:
    return F.call_function("div", x.cast("long"), F.lit(n).cast("long"))


def _keys(seed: int) -> list[int]:
    return [seed * 1_000_003 + r for r in range(ROUNDS)]


def _permute(x: Column, n: int, seed: int) -> Column:
    """One pass of the Feistel network over Z_a x Z_b; a struct carries both sides from round to round."""
    a, b = _sides(n)
    state = F.struct((x % F.lit(a)).alias("l"), _div(x, a).alias("r"))
    rounds = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(i % 2).alias("odd")) for i, k in enumerate(_keys(seed))])

    def step(s: Column, k: Column) -> Column:
        left = F.when(k["odd"] == 0, F.pmod(s["l"] + F.pmod(F.xxhash64(k["key"], s["r"]), F.lit(a).cast("long")), F.lit(a).cast("long"))).otherwise(s["l"])
        right = F.when(k["odd"] == 1, F.pmod(s["r"] + F.pmod(F.xxhash64(k["key"], s["l"]), F.lit(b).cast("long")), F.lit(b).cast("long"))).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(rounds, state, step, lambda s: s["l"] + s["r"] * F.lit(a).cast("long"))


def _unpermute(y: Column, n: int, seed: int) -> Column:
    a, b = _sides(n)
    state = F.struct((y % F.lit(a)).alias("l"), _div(y, a).alias("r"))
    rounds = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(i % 2).alias("odd")) for i, k in reversed(list(enumerate(_keys(seed))))])

    def step(s: Column, k: Column) -> Column:
        left = F.when(k["odd"] == 0, F.pmod(s["l"] - F.pmod(F.xxhash64(k["key"], s["r"]), F.lit(a).cast("long")), F.lit(a).cast("long"))).otherwise(s["l"])
        right = F.when(k["odd"] == 1, F.pmod(s["r"] - F.pmod(F.xxhash64(k["key"], s["l"]), F.lit(b).cast("long")), F.lit(b).cast("long"))).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(rounds, state, step, lambda s: s["l"] + s["r"] * F.lit(a).cast("long"))


def _walk(x: Column, n: int, once) -> Column:
    """Apply ``once`` until the place lies below n.

    Fewer than a = ceil(sqrt(n)) places lie beyond n, so a walk takes a further step with
    probability 1/sqrt(n) and ends after at most a steps: the long walk costs O(1) a row on average and always ends inside the range.
    """
    a, b = _sides(n)

    def further(start: Column, steps: int) -> Column:
        return F.when(start < n, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda acc, _: F.when(acc < n, acc).otherwise(once(acc))))

    x = x.cast("long")
    return further(further(once(x), FIRST_STEPS), a * b - n + 1)


def place_of(row: Column, n: int, seed: int = 0) -> Column:
    """Place of row number ``row`` (0 to n-1) in the shuffle of n rows."""
    return _walk(row, n, lambda x: _permute(x, n, seed))


def row_of(place: Column, n: int, seed: int = 0) -> Column:
    """Row number at ``place``: the inverse of ``place_of``."""
    return _walk(place, n, lambda y: _unpermute(y, n, seed))


def number_rows(df: DataFrame, keys: list[str], rows_per_bucket: int = 500_000) -> tuple[DataFrame, int]:
    """Dense numbers 0 to n-1 in column ``row_number``, fixed by the rows alone; and n.

    Two reads of ``df``: one counts rows by bucket, one numbers them.
    """
    total = df.count()
    buckets = max(16, -(-total // rows_per_bucket))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    # one row a bucket, so one in ``rows_per_bucket`` of the rows: few enough for one window
    counts = df.select(bucket.alias("_b")).groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select(F.col("_b").alias("_bucket"), (F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")).alias("_first"))
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", bucket)
    upto = F.sum("_n").over(Window.partitionBy("_b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    base = groups.withColumn("_upto", upto).join(before, F.col("_b") == F.col("_bucket")).withColumn("_at", F.col("_upto") - F.col("_n") + F.col("_first"))
    # a group of equal rows unfolds chunk by chunk, the chunks dealt out anew
    chunks = base.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_n") - 1).cast("long"), F.lit(CHUNK).cast("long"))))
    dealt = chunks.repartition(F.xxhash64(*keys, "_c"))
    out = dealt.withColumn("row_number", F.explode(F.sequence(F.col("_at") + F.col("_c"), F.col("_at") + F.least("_n", F.col("_c") + CHUNK) - 1)))
    return out.select(*keys, "row_number"), total


def shard_rows(documents: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, place, shard, slot) for every row of ``documents``."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents.select(F.col("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows, n = number_rows(slim, ["doc_id", "size", "text_crc32"])
    if n == 0:
        place = F.lit(None).cast("long")
    else:
        place = place_of(F.col("row_number"), n, seed)
    placed = rows.withColumn("place", place)
    return placed.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).withColumn("slot", _div(F.col("place"), shards))


def write_shards(documents: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """Write the rows themselves, one folder a shard, rows in slot order within each file.

    ``documents`` is joined with its places by (doc_id, size, CRC); equal rows
    are told apart by a number within their group, given part by part of the table, so a large group meets no single task. A caller's columns
    ``shard`` and ``slot`` are written as ``shard_before`` and ``slot_before``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = ["doc_id", "size", "text_crc32"]
    mine = [f"_w_{k}" for k in keys]
    placed = shard_rows(documents, shards, seed)
    full = aside(documents).withColumns({"_w_doc_id": F.col("doc_id"), "_w_size": (F.octet_length(text) + 8).cast("long"), "_w_text_crc32": F.crc32(F.encode(text, "UTF-8")), "_w_part": F.spark_partition_id()})
    full = stored(full, "shard-rows")  # the part must not change between its two uses
    sizes = full.groupBy(*mine, "_w_part").agg(F.count(F.lit(1)).alias("_w_c"))
    over = Window.partitionBy(*mine).orderBy("_w_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = sizes.select(*[F.col(k).alias(f"_b{k}") for k in [*mine, "_w_part"]], (F.sum("_w_c").over(over) - F.col("_w_c")).alias("_w_begin"))
    nth = F.row_number().over(Window.partitionBy(*mine, "_w_part").orderBy(*mine)) - 1
    same = lambda a, b, names: reduce(and_, [F.col(a + k).eqNullSafe(F.col(b + k)) for k in names])
    numbered = full.withColumn("_w_nth", nth).join(begins, same("", "_b", [*mine, "_w_part"])).withColumn("_w_nth", F.col("_w_nth") + F.col("_w_begin"))
    # equal rows have neighbouring row numbers
    first = placed.groupBy(*keys).agg(F.min("row_number").alias("_p_first"))
    numbered = numbered.join(first.select(*[F.col(k).alias(f"_f_w_{k}") for k in keys], "_p_first"), same("", "_f", mine)).withColumn("_w_row", F.col("_p_first") + F.col("_w_nth"))
    joined = numbered.join(placed.select(F.col("row_number").alias("_w_number"), F.col("shard").alias("_w_shard"), F.col("slot").alias("_w_slot")), F.col("_w_row") == F.col("_w_number"))
    named = lambda c: f"{c}_before" if c in ("shard", "slot") else c
    out = joined.select(*[F.col(f"`{m}`").alias(named(c)) for m, c in zip(aside(documents).columns, documents.columns, strict=True)], F.col("_w_shard").alias("shard"), F.col("_w_slot").alias("slot"))
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 23 under the law ``rows``."""
    out = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=24, seed=20)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "place")
