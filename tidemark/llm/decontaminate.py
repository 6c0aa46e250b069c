"""Benchmark decontamination over a stored, distributed positional inverted index.

``build_index`` turns the documents into index segments, one row each: the segment's
documents and, for each term, the list of its positions (in the concatenated words of the
segment). Segments are made where the documents are read and stored as Parquet in the shared folder, so no posting
is shuffled and no term, however frequent, gathers in one task. Test phrases go to all segments in blocks of ``BLOCK_PHRASES``, one block at a time: neither the driver nor a
worker holds more of a large benchmark than that, and hits of different blocks are merged by document. In each segment a phrase starts from
its rarest term's list and is intersected with the other lists, shifted by
their offsets. ``near`` finds the places where terms stand within a distance.

Defined results: null or wordless text has 0 words and no hit; a benchmark item without words
has no phrase; equal phrases of several items count for each; overlapping occurrences
count each word once; repeated rows get equal results; an empty benchmark hits
nothing; an empty table gives no rows; extra columns pass through ``drop_hits`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import aside, dropped, restored, stored

WINDOW = 10
#: Words of a segment (a longer document is a segment of its own) and phrases of a block sent to all segments.
SEGMENT_WORDS = 1_000_000
BLOCK_PHRASES = 200_000
#: Index only the test terms while there are at most so many; else all terms.
VOCABULARY = 500_000

#: Bytes: A-Z to lower case; 0-9, a-z and all bytes of non-ASCII characters stay; the rest separates words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


SEGMENT = "seg bigint, doc_ids array<bigint>, digests array<bigint>, ends array<bigint>, terms array<binary>, places array<bigint>, positions array<int>"


def _segment(number: int, ids: list, digests: list, ends: list[int], lookup: dict[bytes, int], codes: list[np.ndarray]) -> pa.RecordBatch:
    code = np.concatenate(codes) if codes else np.empty(0, np.int32)
    order = np.argsort(code, kind="stable")
    known = order[np.searchsorted(code[order], 0) :]
    counts = np.bincount(code[known], minlength=len(lookup))
    used = np.flatnonzero(counts)
    names = list(lookup)
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.record_batch(
        [pa.array([number], pa.int64()), one(ids, pa.int64()), one(digests, pa.int64()), one(ends, pa.int64()), one([names[t] for t in used], pa.binary()), one(np.cumsum(counts[used]), pa.int64()), one(known.astype(np.int32), pa.int32())],
        names=["seg", "doc_ids", "digests", "ends", "terms", "places", "positions"],
    )


def build_index(documents: DataFrame, vocabulary: list[bytes] | None = None) -> DataFrame:
    """Index segments (see ``SEGMENT``) of whole texts; with a vocabulary, postings of its terms only."""
    fixed = {t: i for i, t in enumerate(vocabulary)} if vocabulary is not None else None

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, ends, codes, n = [], [], [], [], 0
        number = TaskContext.get().partitionId() << 32
        lookup = dict(fixed) if fixed is not None else {}
        for batch in batches:
            for doc_id, digest, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                w = words_of(text)
                if n and n + len(w) > SEGMENT_WORDS:
                    yield _segment(number, ids, digests, ends, lookup, codes)
                    number += 1
                    ids, digests, ends, codes, n = [], [], [], [], 0
                    lookup = dict(fixed) if fixed is not None else {}
                if fixed is not None:
                    code = np.fromiter((lookup.get(x, -1) for x in w), np.int32, len(w))
                else:
                    code = np.fromiter((lookup.setdefault(x, len(lookup)) for x in w), np.int32, len(w))
                n += len(w)
                ids.append(doc_id)
                digests.append(digest)
                ends.append(n)
                codes.append(code)
        if ids:
            yield _segment(number, ids, digests, ends, lookup, codes)

    return documents.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(build, SEGMENT)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Index rows with their lists as arrays; only terms become Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
            yield {n: v.as_py() if n in ("seg", "terms") else v.values.to_numpy(zero_copy_only=False) if n in ("ends", "places", "positions") else v.values for n, v in row.items()}


class Postings:
    """One segment's lists."""

    def __init__(self, row: dict):
        self.ends = np.asarray(row["ends"], np.int64)
        self.term = {t: i for i, t in enumerate(row["terms"])}
        self.stop = np.asarray(row["places"], np.int64)
        self.start = np.concatenate([[0], self.stop[:-1]]) if len(self.stop) else self.stop
        self.count = self.stop - self.start
        self.positions = np.asarray(row["positions"], np.int64)
        # which term stands where: membership in a list without a search
        self.at = np.full(int(self.ends[-1]) if len(self.ends) else 0, -1, np.int64)
        self.at[self.positions] = np.repeat(np.arange(len(self.count)), self.count)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, side="right")

    def phrases(self, terms: list[bytes], codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every occurrence; ``codes``: a row of indexes into ``terms`` for each phrase, -1 beyond its length."""
        local = np.array([self.term.get(t, -1) for t in terms] + [-2], np.int64)[codes]
        live = np.flatnonzero((local != -1).all(1))
        none = np.empty(0, np.int64)
        if not len(live):
            return none, none
        local = local[live]
        rarity = np.where(local < 0, np.iinfo(np.int64).max, self.count[np.maximum(local, 0)])
        order = np.argsort(rarity, axis=1, kind="stable")
        first = order[:, 0]
        term = local[np.arange(len(live)), first]
        n = self.count[term]
        phrase = np.repeat(np.arange(len(live)), n)
        within = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
        start = self.positions[np.repeat(self.start[term], n) + within] - np.repeat(first, n)
        size = lengths[live]
        ok = (start >= 0) & (start + size[phrase] <= len(self.at))
        phrase, start = phrase[ok], start[ok]
        for k in range(1, order.shape[1]):  # the next rarest list, shifted by its offset
            offset = order[phrase, k]
            want = local[phrase, offset]
            place = np.minimum(start + offset, len(self.at) - 1)
            ok = (want < 0) | (self.at[place] == want)
            phrase, start = phrase[ok], start[ok]
        ok = self.document(start) == self.document(start + size[phrase] - 1)
        return live[phrase[ok]], start[ok]

    def near(self, terms: list[bytes], distance: int) -> np.ndarray:
        """Positions of the first term with every other term at most ``distance`` words away in the same document; rarest others first."""
        if not terms or any(t not in self.term for t in terms):
            return np.empty(0, np.int64)
        own = lambda t: self.positions[self.start[t] : self.stop[t]]
        at = own(self.term[terms[0]])
        doc = self.document(at)
        for other in sorted((own(t) for t in {self.term[t] for t in terms[1:]}), key=len):
            k = np.searchsorted(other, at)
            before, after = other[np.maximum(k - 1, 0)], other[np.minimum(k, len(other) - 1)]
            good = np.zeros(len(at), bool)
            for p in (before, after):
                good |= (np.abs(p - at) <= distance) & (self.document(p) == doc)
            at, doc = at[good], doc[good]
        return at


def phrases_of(benchmark: DataFrame, window: int = WINDOW) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, list[list[int]]]]:
    """Blocks of distinct phrases: terms, codes, lengths, and the items of each phrase. Items are streamed, not collected at once."""
    found: dict[tuple[bytes, ...], dict[int, None]] = {}
    for row in benchmark.select("item_id", "text").toLocalIterator():
        w = words_of(row["text"])
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[i : i + window]), {})[row["item_id"]] = None
        if len(found) >= BLOCK_PHRASES:
            yield _coded(found, window)
            found = {}
    if found:
        yield _coded(found, window)


def _coded(found: dict, window: int) -> tuple:
    lookup: dict[bytes, int] = {}
    codes = np.full((len(found), window), -1, np.int32)
    for k, phrase in enumerate(found):
        codes[k, : len(phrase)] = [lookup.setdefault(t, len(lookup)) for t in phrase]
    return list(lookup), codes, np.array([len(p) for p in found], np.int64), [list(x) for x in found.values()]


FOUND = "doc_id bigint, digest bigint, n_words bigint, n_hit bigint, items array<bigint>"


def search(index: DataFrame, block) -> DataFrame:
    """(doc_id, digest, n_words, n_hit, items) for every document of the index; ``block``: a broadcast of the only block of ``phrases_of``, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            p = Postings(row)
            steps = np.zeros(len(p.at) + 1, np.int64)
            items: dict[int, set] = {}
            if block is not None:
                terms, codes, lengths, owners = block.value
                phrase, start = p.phrases(terms, codes, lengths)
                np.add.at(steps, start, 1)
                np.add.at(steps, start + lengths[phrase], -1)
                for d, k in set(zip(p.document(start).tolist(), phrase.tolist())):  # noqa: B905
                    items.setdefault(d, set()).update(owners[k])
            hit = np.concatenate([[0], np.cumsum(np.cumsum(steps[:-1]) > 0)])
            begin = np.concatenate([[0], p.ends[:-1]])
            cols = [row["doc_ids"], row["digests"], pa.array(p.ends - begin, pa.int64()), pa.array(hit[p.ends] - hit[begin], pa.int64()), pa.array([sorted(items.get(d, ()), key=str) for d in range(len(p.ends))], pa.list_(pa.int64()))]
            yield pa.record_batch(cols, names=[f.split()[0] for f in FOUND.split(", ")])

    return index.mapInArrow(run, FOUND)


def hits_of(index: DataFrame, block) -> DataFrame:
    """(seg, place, spans, items) of every document that a block's phrases hit: spans of words in the segment, not merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, codes, lengths, owners = block.value
        for row in _rows(batches):
            p = Postings(row)
            phrase, start = p.phrases(terms, codes, lengths)
            spans: dict[int, set] = {}
            items: dict[int, set] = {}
            for d, a, k in zip(p.document(start).tolist(), start.tolist(), phrase.tolist(), strict=True):
                spans.setdefault(d, set()).add((a, a + int(lengths[k])))
                items.setdefault(d, set()).update(owners[k])
            span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            cols = [pa.array([row["seg"]] * len(spans), pa.int64()), pa.array(list(spans), pa.int64()), pa.array([[{"a": a, "b": b} for a, b in sorted(x)] for x in spans.values()], span), pa.array([sorted(items[d]) for d in spans], pa.list_(pa.int64()))]
            yield pa.record_batch(cols, names=["seg", "place", "spans", "items"])

    return index.mapInArrow(run, "seg bigint, place bigint, spans array<struct<a:bigint,b:bigint>>, items array<bigint>")


def merged(index: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of several blocks as ``search`` would give them."""
    per = hits.groupBy("seg", "place").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    # words covered: each span adds what lies behind the furthest end so far
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    grown = lambda x, s: F.struct((x["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], x["upto"]))).alias("n"), F.greatest(s["b"], x["upto"]).alias("upto"))
    by_text = F.transform(F.array_sort(F.transform(F.array_distinct("i"), lambda x: F.struct(x.cast("string").alias("t"), x.alias("x")))), lambda y: y["x"])
    per = per.select(F.col("seg").alias("hs"), F.col("place").alias("hp"), F.aggregate("s", start, grown, lambda x: x["n"]).alias("n_hit"), by_text.alias("items"))
    before = F.concat(F.array(F.lit(0).cast("long")), F.col("ends"))
    docs = index.select("seg", F.posexplode(F.arrays_zip("doc_ids", "digests", "ends", before.alias("b"))).alias("place", "d")).where("d.ends is not null")
    docs = docs.select("seg", "place", "d.doc_ids", "d.digests", (F.col("d.ends") - F.col("d.b")).alias("n_words"))
    out = docs.join(per, (F.col("seg") == F.col("hs")) & (F.col("place") == F.col("hp")), "left")
    return out.select(F.col("doc_ids").alias("doc_id"), F.col("digests").alias("digest"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def near(index: DataFrame, phrases: list[str], distance: int) -> DataFrame:
    """(doc_id, phrase, position) where all words of a query stand within ``distance`` of its first word."""
    queries = [words_of(p) for p in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            p = Postings(row)
            begin = np.concatenate([[0], p.ends[:-1]])
            out = [(row["doc_ids"][d].as_py(), k, int(a - begin[d])) for k, q in enumerate(queries) for a in p.near(q, distance) for d in [int(p.document(a))]]
            yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["doc_id", "phrase", "position"])

    return index.mapInArrow(run, "doc_id bigint, phrase bigint, position bigint")


def _vocabulary(benchmark: DataFrame, window: int) -> list[bytes] | None:
    """The terms of all phrases, if these are few enough to index only them."""
    terms: set[bytes] = set()
    for block in phrases_of(benchmark, window):
        terms.update(block[0])
        if len(terms) > VOCABULARY:
            return None
    return sorted(terms)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, digest, n_words, n_hit, items) for every row of ``documents``."""
    sc = documents.sparkSession.sparkContext
    index = stored(build_index(documents, _vocabulary(benchmark, window)), "postings")
    blocks = phrases_of(benchmark, window)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return search(index, None if first is None else sc.broadcast(first))
    hits = None
    for block in chain((first, second), blocks):
        sent = sc.broadcast(block)
        new = stored(hits_of(index, sent), "hits")
        sent.destroy()
        both = new if hits is None else stored(hits.unionByName(new), "hits")
        if hits is not None:
            dropped(hits)
            dropped(new)
        hits = both
    return merged(index, hits)


def drop_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows without any hit word, with all columns."""
    hit = contamination(documents, benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias("_w_hit"), F.col("digest").alias("_w_digest")).distinct()
    kept = aside(documents).join(hit, F.col("doc_id").eqNullSafe(F.col("_w_hit")) & (F.xxhash64("text") == F.col("_w_digest")), "left_anti")
    return restored(kept, documents)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
