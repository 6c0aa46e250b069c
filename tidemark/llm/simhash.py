"""SimHash near-duplicates with pigeonring candidate filtering.

A 64-bit fingerprint of hashed word shingles; two texts are linked if their fingerprints
differ in at most ``BITS`` = 4 bits; the classes are the connected components.

Pigeonring: the bits form a ring of m = 5 segments with d_j differing bits each. If
the sum is at most 4, some start i has a chain whose first l segments together differ in at most
floor(4 l / 5) bits, for every l: 0, 1, 2, 3, 4. Candidates are found by an equi-join on (i, first two
segments): the first must be equal and the second differ in at most one bit, so
one side also looks up its second segment with each of its zero bits set (of
two that differ in a bit, the one with the zero finds the other). The longer prefixes and the
full Hamming distance are checked in the join condition, and a pair is reported by its first valid start only, so no
pair leaves the join that isn't a link. Starts whose two-segment key holds more than ``HOT``
fingerprints use the three-segment key with all its allowed differences instead: the same links,
but no large group is compared with itself.

Work is done on distinct fingerprints: copies count once, and rows get their class by a join.

Defined results: null or wordless text has fingerprint 0 and is linked like any other; fewer words
than the shingle size give one shingle of all words; component_id is the smallest doc_id of
the class (null only if the class has none but null); repeated rows give repeated results; an empty
table gives no rows; other columns pass through ``keep_first`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import link_components, one_of_each, row_key, stored

BITS = 4
EDGES = (0, 13, 26, 39, 52, 64)
M = len(EDGES) - 1
#: Fingerprints on one two-segment key above which the three-segment key is used.
HOT = 1024
SEED = 42
#: Shingles hashed at a time: bounds memory for very long texts.
SLICE = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment(i: int) -> int:
    lo, hi = EDGES[i % M], EDGES[i % M + 1]
    return ((1 << hi) - 1) ^ ((1 << lo) - 1)


def chain_mask(i: int, length: int) -> int:
    return sum(segment(i + j) for j in range(length))


def chain_differences(i: int, length: int) -> list[int]:
    """All differences within the first ``length`` segments from start i that keep every budget floor(BITS * l / M)."""
    bits = [(b, j) for j in range(length) for b in range(64) if segment(i + j) >> b & 1]
    out = []
    for n in range(BITS * length // M + 1):
        for chosen in combinations(bits, n):
            if all(sum(j < upto for _, j in chosen) <= BITS * upto // M for upto in range(1, length + 1)):
                out.append(sum(1 << b for b, _ in chosen))
    return out


def fingerprint_of(text: str | None, size: int = 4) -> int:
    """64-bit SimHash of the text's word shingles (signed): a bit is 1 if set in over half of the hashes."""
    import xxhash

    joined = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not joined:
        return 0
    line = b" ".join(joined)
    ends = np.cumsum([len(w) + 1 for w in joined]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(size, len(joined)) - 1 :].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    n = len(stops)
    hashes = (np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[at : at + SLICE], stops[at : at + SLICE])), np.uint64) for at in range(0, n, SLICE))  # noqa: B905
    return majority(hashes, n)


def majority(hashes: Iterable[np.ndarray], n: int) -> int:
    """The bits (signed) that are set in over half of n 64-bit hashes, given in slices."""
    ones = np.zeros(64, np.int64)
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, size: int = 4) -> Column:
    """Arrow-batched column of fingerprints."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, size) for t in texts], dtype="int64")

    return of(text)


def _valid(diff: Column, i: int) -> Column:
    """Every prefix of the chain from start i is within its budget."""
    count = lambda j: F.bit_count(diff.bitwiseAND(F.lit(_signed(segment(i + j))))).cast("int")
    out, total = None, None
    for j in range(M):
        total = count(j) if total is None else total + count(j)
        ok = total <= BITS * (j + 1) // M
        out = ok if out is None else out & ok
    return out


def _first_valid(diff: Column, start: Column) -> Column:
    """``start`` is the first valid start of the pair."""
    out = F.lit(M)
    for i in reversed(range(M)):
        out = F.when(_valid(diff, i), i).otherwise(out)
    return start == out


def _deciding(diff: int, i: int) -> int:
    """The bit that tells which of two fingerprints looks up the other: the lowest in the second segment, else the lowest. So both key lengths agree."""
    part = diff & segment(i + 1) or diff
    return part & -part


def _index(fps: DataFrame, length: int) -> DataFrame:
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(chain_mask(i, length))).alias("part")) for i in range(M)])
    return fps.select("fp", F.explode(table).alias("t")).select(F.col("fp").alias("y"), F.col("t.i").alias("i"), F.col("fp").bitwiseAND(F.col("t.part")).alias("key"))


def _probe(fps: DataFrame, length: int) -> DataFrame:
    """Keys that a fingerprint looks up: its own, and those an allowed difference away whose deciding bit it lacks."""
    masks = [(i, _signed(chain_mask(i, length)), _signed(d), _signed(_deciding(d, i))) for i in range(M) for d in chain_differences(i, length)]
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("part"), F.lit(d).alias("diff"), F.lit(low).alias("low")) for i, p, d, low in masks])
    own = fps.select("fp", F.explode(table).alias("t")).where(F.col("fp").bitwiseAND(F.col("t.low")) == 0)
    return own.select(F.col("fp").alias("x"), F.col("t.i").alias("i"), F.col("fp").bitwiseXOR(F.col("t.diff")).bitwiseAND(F.col("t.part")).alias("key"), (F.col("t.diff") == 0).alias("own"))


def _meet(probe: DataFrame, index: DataFrame) -> DataFrame:
    diff = F.col("x").bitwiseXOR(F.col("y"))
    link = (probe["i"] == index["i"]) & (probe["key"] == index["key"]) & (~F.col("own") | (F.col("x") < F.col("y"))) & (F.bit_count(diff) <= BITS) & _first_valid(diff, probe["i"])
    # both sides are unfolded many times over, which size estimates don't see: never broadcast them
    return probe.hint("merge").join(index.hint("merge"), link).select("x", "y")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (x, y) of distinct fingerprints (column ``fp``) that differ in at most BITS bits, once each."""
    index, probe = _index(fps, 2), _probe(fps, 2)
    hot = stored(index.groupBy("i", "key").count().where(F.col("count") > HOT).select("i", "key"), "hot")
    calm = _meet(probe.join(hot, ["i", "key"], "left_anti"), index.join(hot, ["i", "key"], "left_anti"))
    if hot.isEmpty():
        return _meet(probe, index)
    # the pair's two-segment key at its first valid start is hot: look it up by three segments
    in_hot = lambda df: df.withColumn("k2", F.col("key").bitwiseAND(_two(F.col("i")))).join(hot.withColumnRenamed("key", "k2"), ["i", "k2"], "left_semi").drop("k2")
    near = probe.join(hot, ["i", "key"], "left_semi").select(F.col("x").alias("fp")).distinct()
    own = index.join(hot, ["i", "key"], "left_semi").select(F.col("y").alias("fp")).distinct()
    return calm.unionByName(_meet(in_hot(_probe(near, 3)), in_hot(_index(own, 3))))


def _two(i: Column) -> Column:
    return F.get(F.array(*[F.lit(_signed(chain_mask(j, 2))) for j in range(M)]), i)


def classes_of(documents: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, key, fp, part) for every row: ``part`` is the smallest fingerprint of its class."""
    rows = stored(documents.select("doc_id", row_key().alias("key"), fingerprint(F.col("text"), size).alias("fp")), "fingerprints")
    parts = link_components(links(rows.select("fp").distinct()), "x", "y")
    return rows.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "key", "fp", F.coalesce("component", "fp").alias("part"))


def near_classes(documents: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    rows = stored(documents.select("doc_id", fingerprint(F.col("text"), size).alias("fp")), "fingerprints")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    parts = link_components(links(first.select("fp")), "x", "y")
    named = first.join(parts, first["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
    smallest = named.groupBy("part").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "part").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(documents: DataFrame, size: int = 4) -> DataFrame:
    """One row of each class, with all columns (see ``common.one_of_each``)."""
    return one_of_each(documents, stored(classes_of(documents, size), "classes").select("doc_id", "key", "part"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
