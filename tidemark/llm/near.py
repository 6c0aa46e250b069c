"""Near-duplicates: SimHash links for close copies, completed to all texts of a Jaccard similarity of 0.8 or more.

Two texts are linked if the sets of their ``SIZE``-word shingles have a Jaccard similarity of at least 0.8; the
classes are the connected components. Candidates come from two places, and every one is checked on the whole sets:

* Pigeonring joins of the sets' SimHash fingerprints (see ``simhash``) find close copies; each text is tried with its
  smallest neighbour. At 0.8, though, fingerprints differ in about ten of 64 bits, so most such pairs lie beyond the 4 bits.
* Prefix filtering finds all the others. In any fixed order of the
  shingles, two sets of at least that similarity share one of their first n - ceil(0.8 n) + 1 shingles, so
  only these are joined; and behind the first one they share, enough must follow in both (positional filter).

The order puts common shingles last, so that few unlike texts meet. How common they are is
estimated on one text of ``SAMPLE``; a wrong estimate costs time, never a link. Texts that share a shingle meet in rounds:
all with one hub, which changes from round to round, until few pairs of different classes are left; then those, so a large class isn't compared with itself.

Defined results: shingles are of lower-case words (A-Z and ASCII white space only); fewer words than the shingle size give one
shingle of all words; null and wordless texts have the empty set and are alike; rows with equal sets are alike; of a class the smallest doc_id
stays (null only if it has none but null), of equal ones the smallest text hash, of equal rows an arbitrary one;
an empty table gives no rows; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import dropped, freed, link_components, one_of_each, row_key, stored

SIZE = 5
#: One text of so many is counted to order the shingles; those in at least COMMON of them, MOST at most, go last.
SAMPLE, COMMON, MOST = 8, 4, 100_000
#: Rounds with one hub a shingle at most, before all pairs of different classes that are left.
ROUNDS = 8
#: Bits of the map that tells which texts are asked for.
BITMAP = 1 << 24
#: All pairs are compared once a text has at most so many partners of other classes on average.
PARTNERS = 16


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes (signed) of the text's word shingles."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    size = min(size, len(h))
    if not size:
        return np.zeros(0, np.int64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for j in range(size):
        out = (out ^ h[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles in the order (rank among the common ones, hash). ``common`` is sorted."""
    n = len(found)
    if not n:
        return found
    last = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        last = np.where(common[at] == found, rank[at], 0)
    return found[np.lexsort((found, last))[: n - (4 * n + 4) // 5 + 1]]


def _common(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and their ranks by how often they occur (from 1)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([shingles(t.as_py()) for t in batch.column(0)], pa.list_(pa.int64()))], names=["s"])

    some = documents.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(of, "s array<bigint>")
    often = some.select(F.explode("s").alias("s")).groupBy("s").count().where(F.col("count") >= COMMON)
    rows = often.orderBy(F.desc("count"), "s").limit(MOST).collect()
    common = np.array([r["s"] for r in reversed(rows)], np.int64)
    order = np.argsort(common)
    return common[order], np.arange(1, len(common) + 1)[order]


def _prefixes(documents: DataFrame) -> DataFrame:
    """(doc_id, key, sig, n, fp, prefix) for every row; sig is a hash of the whole set, fp its SimHash."""
    order = documents.sparkSession.sparkContext.broadcast(_common(documents))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(2)]
            sig = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            cols = [pa.array(sig), pa.array([len(s) for s in sets], pa.int32()), pa.array([simhash.majority([s.view(np.uint64)], len(s)) for s in sets], pa.int64()), pa.array([prefix(s, *order.value) for s in sets], pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column(0), batch.column(1), *cols], names=["doc_id", "key", "sig", "n", "fp", "prefix"])

    return documents.select("doc_id", row_key().alias("key"), "text").mapInArrow(of, "doc_id bigint, key bigint, sig bigint, n int, fp bigint, prefix array<bigint>")


def _asked(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, key, text) of the rows whose key may be among ``keys``: a bitmap of fixed size spares the others' texts the exchange. What it lets through is joined exactly."""
    h = F.pmod("key", F.lit(BITMAP))
    words = keys.groupBy(F.shiftright(h, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(key, {BITMAP}) % 64 as int)))").alias("bits")).collect()  # at most BITMAP / 64 rows
    table = np.zeros(BITMAP // 64, np.int64)
    table[[r["w"] for r in words]] = [r["bits"] for r in words]
    bits = documents.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy() % BITMAP
            yield batch.filter(pa.array((bits.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    return documents.select("doc_id", row_key().alias("key"), "text").mapInArrow(of, "doc_id bigint, key bigint, text string")


#: So many chance hits of half hashes are allowed for, and so many times the expected number, before a pair counts as certain.
SLACK = 8


def _alike(pairs: DataFrame, documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the candidate pairs (a, b) whose whole sets have a Jaccard similarity of at least 0.8.

    The sets travel as the upper halves of their hashes first. Halves bound the number of shared shingles from both sides: of equal shingles the
    halves are equal, and unlike ones share theirs by chance, of which more than ``SLACK`` allows for don't occur. Pairs that the bounds leave open are decided on the whole hashes.
    """
    shared = F.size(F.array_intersect("x", "y"))
    # shared / (n + m - shared) >= 4 / 5, for the least and the greatest number of shared shingles
    chance = F.ceil(SLACK + 4 * F.col("n").cast("double") * F.col("m") / (1 << 32))
    merged = F.least(F.col("n") - F.size("x"), F.col("m") - F.size("y"))
    met, held = _met(pairs, documents, rows, 32)
    met = met.withColumns({"sure": 9 * (shared - chance) >= 4 * (F.col("n") + F.col("m")), "maybe": 9 * (shared + merged) >= 4 * (F.col("n") + F.col("m"))})
    first = stored(met.where("maybe").select("a", "b", "sure"), "near-links")
    dropped(held)
    freed(documents.sparkSession)
    open_ = first.where("not sure").select("a", "b")
    if open_.isEmpty():
        out = first.select("a", "b")
        out.stored_path = first.stored_path
        return out
    whole, held = _met(open_, documents, rows, 64)
    whole = whole.where(9 * shared >= 4 * (F.col("n") + F.col("m")))
    out = stored(first.where("sure").select("a", "b").unionByName(whole.select("a", "b")), "near-links")
    for frame in (held, first):
        dropped(frame)
    freed(documents.sparkSession)
    return out


def _met(pairs: DataFrame, documents: DataFrame, rows: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """((a, b, n, m, x, y), the stored sets): candidate pairs with the sizes of their sets, and the sets as the upper ``bits`` of their hashes."""
    kind, np_kind = ("int", np.int32) if bits == 32 else ("bigint", np.int64)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [shingles(t.as_py()) for t in batch.column(1)]
            cut = [np.unique((s >> (64 - bits)).astype(np_kind)) for s in whole]
            yield pa.record_batch([batch.column(0), pa.array([len(s) for s in whole], pa.int32()), pa.array(cut, pa.list_(pa.from_numpy_dtype(np_kind)))], names=["sig", "n", "s"])

    asked = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    one = rows.join(asked, "sig", "left_semi").groupBy("sig").agg(F.min(F.struct("doc_id", "key")).alias("r")).select("sig", F.col("r.doc_id").alias("rd"), F.col("r.key").alias("rk"))
    one = stored(one, "near-asked")
    texts = _asked(documents, one.select(F.col("rk").alias("key"))).join(one, F.col("doc_id").eqNullSafe(F.col("rd")) & (F.col("key") == F.col("rk")))
    held = stored(texts.select("sig", "text").mapInArrow(of, f"sig bigint, n int, s array<{kind}>"), "near-sets")
    dropped(one)
    sets = held.dropDuplicates(["sig"])
    x, y = (sets.select(F.col("sig").alias(a), F.col("n").alias(n), F.col("s").alias(s)) for a, n, s in (("a", "n", "x"), ("b", "m", "y")))
    return pairs.join(x, "a").join(y, "b"), held


def _close(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of sets with close fingerprints: each with its fingerprint's first set, and that with the smallest neighbour's."""
    sets = stored(rows.select("sig", "fp").distinct(), "near-fingerprints")
    first = sets.groupBy("fp").agg(F.min("sig").alias("sig"))
    same = sets.withColumnRenamed("sig", "b").join(first, "fp").where("sig != b").select(F.col("sig").alias("a"), "b")
    pairs = simhash.links(first.select("fp"))
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("y < x")
    low = both.groupBy("x").agg(F.min("y").alias("y"))
    near = low.join(first.select(F.col("fp").alias("x"), F.col("sig").alias("a")), "x").join(first.select(F.col("fp").alias("y"), F.col("sig").alias("b")), "y").select("a", "b")
    return same.unionByName(near)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes_of(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, component) of all sets that have a link."""
    posts = rows.dropDuplicates(["sig"]).select("sig", "n", F.posexplode("prefix").alias("i", "s"))
    many = posts.groupBy("s").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("s")
    posts = stored(posts.join(many, "s", "left_semi"), "near-posts")
    freed(documents.sparkSession)


    def alike(x: str, y: str) -> Column:
        """Sizes allow the similarity, and so does what both have from the shared shingle on (true at the first shared one of every pair that is alike)."""
        n, m, i, j = (F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}i"), F.col(f"{y}i"))
        return (4 * F.greatest(n, m) <= 5 * F.least(n, m)) & (9 * F.least(n - i, m - j) >= 4 * (n + m))

    tried = stored(_ordered(_close(rows)), "near-tried")
    freed(documents.sparkSession)
    found = _alike(tried, documents, rows)
    linked, asked = 1, 1
    for turn in range(ROUNDS + 1):
        parts = stored(link_components(found, "a", "b"), "near-parts")
        dropped(found)
        placed = posts.join(parts, F.col("sig") == F.col("node"), "left").select("s", "sig", "n", "i", F.coalesce("component", "sig").alias("part"))
        per = placed.groupBy("s", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("s").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("k2")).where("parts > 1")
        mixed = stored(per, "near-mixed")
        rows_left, pairs_left = mixed.agg(F.sum("k"), F.sum((F.col("k") * F.col("k") - F.col("k2")) / 2)).first()
        if not rows_left:
            return parts
        # texts whose shingles all lie in one class have no further partner
        left = stored(placed.join(mixed.select("s"), "s", "left_semi"), "near-posts")
        dropped(mixed)
        dropped(posts)
        posts = left.select("s", "sig", "n", "i")
        posts.stored_path = left.stored_path
        # hubs pay while they link
        last = turn == ROUNDS or pairs_left <= PARTNERS * rows_left or 10 * linked < asked
        if last:
            x, y = left.alias("x"), left.alias("y")
            apart = (F.col("x.s") == F.col("y.s")) & (F.col("x.part") < F.col("y.part")) & alike("x.", "y.")
            pairs = x.join(y, apart).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"))
        else:  # the hub of a shingle depends on the turn, not on the shingle: shingles of the same texts ask for the same pairs
            hub = left.groupBy("s").agg(F.min(F.struct(F.xxhash64("sig", F.lit(turn)).alias("h"), "sig", "n", "i", "part")).alias("hub"))
            met = left.join(hub, "s").where((F.col("part") != F.col("hub.part")) & alike("", "hub."))
            pairs = met.select(F.col("hub.sig").alias("a"), F.col("sig").alias("b"))
        pairs = stored(_ordered(pairs).join(tried, ["a", "b"], "left_anti"), "near-pairs")
        freed(documents.sparkSession)
        asked, new = pairs.count(), _alike(pairs, documents, rows)
        linked = new.count()
        found = stored(parts.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(new), "near-links")
        for frame in (parts, new):
            dropped(frame)
        if last:
            return link_components(found, "a", "b")
        both = stored(tried.unionByName(pairs), "near-tried")
        for frame in (tried, pairs):
            dropped(frame)
        tried = both
    raise AssertionError("the last round returns")


def keep_first(documents: DataFrame) -> DataFrame:
    """One row of each class, with all columns."""
    rows = stored(_prefixes(documents), "near-prefixes")
    parts = classes_of(documents, rows)
    part = rows.select("doc_id", "key", "sig").join(parts, F.col("sig") == F.col("node"), "left")
    return one_of_each(documents, stored(part.select("doc_id", "key", F.coalesce("component", "sig").alias("part")), "near-classes"))
