"""Line dedup by winnowing over line hashes.

A document is the sequence of the hashes of its lines with words. A window is a run of lines that is the shortest from its first
line, or the shortest to its last line, with at least ``MIN_WORDS`` words. Any line of a run of that many words lies in a window inside the run.

Winnowing: each window selects its line with the least hash (the leftmost of equal ones), so the same run selects the same lines wherever it
stands. The selected lines are the fingerprints: a third or fewer of all lines in prose, one row each, with the windows that selected them. Their
positions are joined on the line's hash; a fingerprint that stands in one place only rules out all its windows, which go no further.

The first holder of a fingerprint need not hold the whole run around it. So a place with a shared fingerprint is matched by the
stretches on both sides that its windows state: each of them is joined with its own first place (by doc_id, then text hash, then line), a star, never
all pairs. A match is extended both ways over the windows that overlap or touch it as long as they are matched too: every window of a repeated run
has its fingerprint in the run, so their union is the maximal run, whichever earlier places hold its parts. The later copy of each maximal run of at least ``MIN_WORDS``
words is deleted. The earliest copy of any line is never deleted: what would delete it is an earlier copy. Work and rows grow with the number of lines, also
in a document of equal lines.

Defined results: lines are compared by their words, white space aside; lines without words
belong to a run if it goes on behind them; null text stays null and has no lines; rows with equal doc_id and text
are one document, all treated alike; an empty table gives no rows; other columns are
kept by ``drop_repeats``, whatever their names, which also drops documents that lose all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import aside, dropped, restored, row_key, stored

MIN_WORDS = 50


def line_hashes(text: str | None) -> tuple[list[int], list[int]]:
    """Signed hash and word count of every line with words."""
    import xxhash

    hashes, counts = [], []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        w = line.split()
        if w:
            h = xxhash.xxh64_intdigest(b" ".join(w))
            hashes.append(h - (1 << 64) if h >> 63 else h)
            counts.append(len(w))
    return hashes, counts


#: Odd factor of the rolling window hash, and its inverse modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def windows(hashes: list[int], counts: list[int], min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first line and line behind the last of every window."""
    n = len(hashes)
    upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    starts = np.flatnonzero(upto[:-1] + min_words <= upto[-1])
    ends = np.flatnonzero(upto >= min_words)
    forward = starts * (n + 1) + np.searchsorted(upto, upto[starts] + min_words)
    back = (np.searchsorted(upto, upto[ends] - min_words, side="right") - 1) * (n + 1) + ends
    start, end = np.divmod(np.unique(np.concatenate([forward, back])), n + 1)
    power = lambda x: np.cumprod(np.array([1] + [x] * n, np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array(hashes, np.int64).view(np.uint64) * power(FACTOR)[:n])])
    g = (sums[end] - sums[start]) * power(INVERSE)[start]
    g = (g ^ (g >> np.uint64(29))) * np.uint64(FACTOR)
    return g.view(np.int64), start.astype(np.int32), end.astype(np.int32)


def minima(hashes: list[int], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The line with the least hash in every window, the leftmost of equal ones."""
    h, size = np.array(hashes, np.int64), end - start
    least, out = np.arange(len(h)), np.zeros(len(start), np.int64)
    lower = lambda x, y: np.where(h[x] <= h[y], x, y)
    span = 1  # least: the least line of the span lines from each line
    while len(start):
        fits = (size >= span) & (size < 2 * span)
        out[fits] = lower(least[start[fits]], least[end[fits] - span])
        if 2 * span > size.max():
            break
        least = lower(least[:-span], least[span:])
        span *= 2
    return out


PRINTS = "doc_id bigint, key bigint, f bigint, marks array<struct<g:bigint,line:int,stop:int>>"


def fingerprints(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The selected lines (see ``PRINTS``) of every row of ``documents``, each with the windows that select it."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, prints, sizes, marks = [], [], [], []
            for row, text in enumerate(batch.column(2)):
                hashes, counts = line_hashes(text.as_py())
                g, line, stop = windows(hashes, counts, min_words)
                if len(g):
                    at = minima(hashes, line, stop)
                    order = np.argsort(at, kind="stable")
                    lines, size = np.unique(at, return_counts=True)
                    rows.append(np.full(len(lines), row))
                    prints.append(np.array(hashes, np.int64)[lines])
                    sizes.append(size)
                    marks.append((g[order], line[order], stop[order]))
            if rows:
                g, line, stop = (pa.array(np.concatenate([m[k] for m in marks])) for k in range(3))
                upto = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
                took = pa.array(np.concatenate(rows))
                parts = pa.ListArray.from_arrays(upto, pa.StructArray.from_arrays([g, line, stop], ["g", "line", "stop"]))
                yield pa.record_batch([batch.column(0).take(took), batch.column(1).take(took), pa.array(np.concatenate(prints)), parts], names=["doc_id", "key", "f", "marks"])

    return documents.select("doc_id", row_key().alias("key"), "text").mapInArrow(select, PRINTS)


def repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, lines): the lines to delete, numbered among lines with words, of each document that has any."""
    prints = stored(fingerprints(documents, min_words), "lines")
    shared = prints.groupBy("f").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("f")
    met = prints.join(shared, "f").select("doc_id", "key", F.explode("marks").alias("m"))
    marks = stored(met.select("m.g", "doc_id", "key", "m.line", "m.stop"), "line-marks")
    dropped(prints)
    first = marks.groupBy("g").agg(F.min(F.struct("doc_id", "key", "line")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("g", "first")
    later = marks.join(first, "g").where(~(F.struct("doc_id", "key", "line").eqNullSafe(F.col("first"))))
    runs = later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("line", "stop")).alias("w"))
    lines = F.flatten(F.transform("w", lambda w: F.sequence(w["line"], w["stop"] - 1)))
    return runs.select("doc_id", "key", F.array_sort(F.array_distinct(lines)).alias("lines"))


def without(text: str | None, gone) -> str | None:
    """The text without these lines (numbered among lines with words); lines without words go with a run that surrounds them."""
    if text is None or gone is None or not len(gone):
        return text
    drop, kept, at, blank = set(gone), [], 0, []
    after_drop = False
    for line in text.split("\n"):
        if not line.encode("utf-8", "surrogatepass").split():
            blank.append(line)
            continue
        if at in drop:
            if not after_drop:
                kept += blank
            after_drop = True
        else:
            kept += blank
            kept.append(line)
            after_drop = False
        blank = []
        at += 1
    return "\n".join(kept + blank)


def with_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` (columns set aside, see ``common.aside``) with ``_w_gone``: the lines to delete, or null."""
    gone = repeated_lines(documents).select(F.col("doc_id").alias("_w_doc"), F.col("key").alias("_w_key"), F.col("lines").alias("_w_gone"))
    return aside(documents).withColumn("_w_row", row_key()).join(gone, F.col("doc_id").eqNullSafe(F.col("_w_doc")) & (F.col("_w_row") == F.col("_w_key")), "left")


def cleaned(text: str, gone: str) -> Column:
    """Arrow-batched column of the texts without their deleted lines."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([without(t, g) for t, g in zip(texts, lines, strict=True)], dtype=object)

    return clean(text, gone)


def drop_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with later repeated runs of lines deleted; documents that lose all their words go."""
    gone = F.col("_w_gone")
    out = with_repeats(documents).withColumn("text", F.when(gone.isNull(), F.col("text")).otherwise(cleaned("text", "_w_gone")))
    return restored(out.where(gone.isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")), documents)


def op10_lines(spark, sf_dir: str) -> DataFrame:
    """Deleted lines of every document, and the CRC-32 of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = F.col("_w_gone")
    stays = F.when(gone.isNull(), F.col("text")).otherwise(cleaned("text", "_w_gone"))
    return with_repeats(docs).select("doc_id", F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_deleted_lines"), F.coalesce(gone, F.array().cast("array<int>")).alias("deleted_lines"), F.crc32(F.encode(F.coalesce(stays, F.lit("")), "UTF-8")).alias("kept_crc32"))
