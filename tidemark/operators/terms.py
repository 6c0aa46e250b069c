"""Filter matching with thousands of terms: one pass over distinct strings, however many terms there are.

A term that is pinned at both ends and is one word is looked up among a string's words by a hash join. All other terms are compiled into one automaton that
reads each distinct string once; what it may hold is bounded, and beyond the bound the terms are cut into parts, each with a pass of its own.
``filters.matching`` tries each term of a source against each row; results are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import filter_normalise
from tidemark.operators import filters as FL

#: Characters of terms that one automaton may hold.
MOST = 4_000_000


def compiled_terms(specs: DataFrame) -> DataFrame:
    """(source_id, field, sort, needle) of specs that ``filters.compiled`` made; sort is Any or None."""
    lists = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"{c}_n").alias("needles")) for c in FL.LISTS])).alias("l")
    rows = specs.select("source_id", lists).select("source_id", "l.c", F.explode("l.needles").alias("needle"))
    return rows.select("source_id", F.regexp_replace("c", "(Any|None)$", "").alias("field"), F.regexp_extract("c", "(Any|None)$", 1).alias("sort"), "needle")


def haystacks(listings: DataFrame) -> DataFrame:
    """Distinct (field, hay): normalised titles, companies and locations."""
    raw = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")) for c in ("title", "company", "location")])
    distinct = listings.select(F.explode(raw).alias("e")).select("e.*").distinct()
    return distinct.withColumn("hay", filter_normalise(F.col("raw")))


def found(hays: DataFrame, terms: DataFrame, most: int = MOST) -> DataFrame:
    """Distinct (field, raw, needle) of the terms that each haystack holds."""
    inner = F.substring("needle", F.lit(2), F.length("needle") - 2)
    is_word = F.col("needle").startswith(" ") & F.col("needle").endswith(" ") & (F.length("needle") > 2) & ~F.instr(inner, " ").cast("boolean")
    words = terms.where(is_word).select("field", "needle", inner.alias("word")).distinct()
    tokens = hays.select("field", "raw", F.explode(F.array_distinct(F.split(F.trim("hay"), " "))).alias("word"))
    out = tokens.join(words, ["field", "word"]).select("field", "raw", "needle")
    rest = terms.where(~is_word).select("needle").distinct()
    parts = max(1, -(-(rest.agg(F.sum(F.length("needle"))).first()[0] or 0) // most))
    for k in range(parts):
        needles = [r["needle"] for r in rest.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == k).collect()]  # bounded by ``most``
        if needles:
            out = out.unionByName(_scan(hays, needles))
    return out.distinct()


def _scan(hays: DataFrame, needles: list[str]) -> DataFrame:
    sent = hays.sparkSession.sparkContext.broadcast(needles)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for n in sent.value:
            machine.add_word(n, n)
        machine.make_automaton()
        for b in batches:
            hits = [(i, n) for i, hay in enumerate(b.column(2).to_pylist()) for n in {n for _, n in machine.iter(hay)}]
            at = pa.array([i for i, _ in hits], pa.int64())
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array([n for _, n in hits], pa.string())], names=["field", "raw", "needle"])

    return hays.select("field", "raw", "hay").mapInArrow(of, "field string, raw string, needle string")


def matching(listings: DataFrame, specs: DataFrame, as_of: Column, most: int = MOST) -> DataFrame:
    """``filters.matching`` for many terms: every listing with ``matches``."""
    terms = compiled_terms(specs)
    held = found(haystacks(listings), terms, most).join(terms, ["field", "needle"])
    hits = held.groupBy("source_id", "field", "raw").agg(F.bool_or(F.col("sort") == "Any").alias("any"), F.bool_or(F.col("sort") == "None").alias("none"))
    j = listings.join(specs.withColumnRenamed("remote", "mode"), "source_id", "left")
    for c in ("title", "company", "location"):
        mine = hits.where(F.col("field") == c).select(F.col("source_id").alias("_s"), F.col("raw").alias("_raw"), F.col("any").alias(f"_any_{c}"), F.col("none").alias(f"_none_{c}"))
        j = j.join(mine, (F.col("source_id") == F.col("_s")) & F.col(c).eqNullSafe(F.col("_raw")), "left").drop("_s", "_raw")
    hit = lambda c, field: F.coalesce(F.col(f"_{field.removeprefix(c).lower()}_{c}"), F.lit(False))
    return j.withColumn("matches", FL.verdict(hit, as_of)).drop(*[f"_{x}_{c}" for x in ("any", "none") for c in ("title", "company", "location")])
