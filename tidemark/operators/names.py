"""Dictionary of normalised strings: each distinct title, company and location is normalised once, however many listings share it, and kept.

Few strings need the Python helper: they are a branch of their own, so the others never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Most strings of a memo: it stays small enough to be broadcast, whatever the listings hold.
MOST_COMMON = 100_000
ENTRIES = "kind string, raw string, remote boolean, value string"


def strings(listings: DataFrame) -> DataFrame:
    """Distinct (kind, raw, remote) of listings; copies are dropped before the exchange. ``remote`` matters for locations only."""
    entry = lambda kind, remote: F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("raw"), remote.alias("remote"))
    none = F.lit(None).cast("boolean")
    every = F.array(entry("title", none), entry("company", none), entry("location", F.col("remote")))
    return listings.select(F.explode(every).alias("e")).select("e.*").distinct()


def normalised(wanted: DataFrame) -> DataFrame:
    """``ENTRIES`` of (kind, raw, remote)."""

    def value(by: T.Fold) -> Column:
        raw, kind = F.col("raw"), F.col("kind")
        return F.when(kind == "title", T.normalise_title(raw, by=by)).when(kind == "company", T.normalise_company(raw, by=by)).otherwise(T.normalise_location(raw, F.col("remote"), by=by))

    helped = T.needs_helper(F.col("raw"))
    plain = wanted.where(~helped).withColumn("value", value(T.fold_mapped))
    return plain.unionByName(wanted.where(helped).withColumn("value", value(T.fold)))


def missing(listings: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, raw, remote) of listings that ``known`` lacks."""
    w, k = strings(listings).alias("w"), known.select("kind", "raw", "remote").alias("k")
    same = (F.col("w.kind") == F.col("k.kind")) & F.col("w.raw").eqNullSafe(F.col("k.raw")) & F.col("w.remote").eqNullSafe(F.col("k.remote"))
    return w.join(k, same, "left_anti").select("kind", "raw", "remote")


def keyed(listings: DataFrame, entries: DataFrame) -> DataFrame:
    """Listings with ``key_full`` and ``key``, from a dictionary that has all their strings."""
    out = listings
    for kind, to in (("title", "_t"), ("company", "_c"), ("location", "_l")):
        mine = entries.where(F.col("kind") == kind).select(F.col("raw").alias("_raw"), F.col("remote").alias("_remote"), F.col("value").alias(to))
        same = F.col(kind).eqNullSafe(F.col("_raw"))
        if kind == "location":
            same = same & F.col("remote").eqNullSafe(F.col("_remote"))
        out = out.join(mine, same, "left").drop("_raw", "_remote")
    full = T.key_full(F.col("_t"), F.col("_c"), F.col("_l"))
    return out.withColumn("key_full", full).withColumn("key", F.left("key_full", F.lit(12))).drop("_t", "_c", "_l")


def _tagged() -> dict[str, Column]:
    """The three strings of a listing, each with a first letter that tells its kind; a location's also tells whether it is remote."""
    place = F.when(F.coalesce(F.col("remote"), F.lit(False)), "r").otherwise("l")
    return {"title": F.concat(F.lit("t"), F.col("title")), "company": F.concat(F.lit("c"), F.col("company")), "location": F.concat(place, F.col("location"))}


def memo(listings: DataFrame, most: int = MOST_COMMON, least: int = 2) -> DataFrame:
    """(tagged, value): normal forms of strings that several listings share (``least``: how many) or that hold characters beyond ASCII, at most so many; the limit bounds its size, not the work of those who look strings up."""
    every = listings.select(F.explode(F.array(*_tagged().values())).alias("tagged")).where("tagged is not null")
    wanted = (F.col("n") >= least) | (F.octet_length("tagged") != F.char_length("tagged"))
    some = every.groupBy("tagged").agg(F.count(F.lit(1)).alias("n")).where(wanted).select("tagged").limit(most)
    kind, raw = F.left("tagged", F.lit(1)), F.substring("tagged", 2, 2**31 - 1)
    x = T.fold(raw)
    as_is = lambda _: x
    value = F.when(kind == "t", T.normalise_title(raw, by=as_is)).when(kind == "c", T.normalise_company(raw, by=as_is))
    return some.select("tagged", value.otherwise(T.normalise_location(raw, kind == "r")).alias("value"))


def with_keys(listings: DataFrame, most: int = MOST_COMMON, known: DataFrame | None = None) -> DataFrame:
    """Listings with ``key_full`` and ``key``: shared strings are looked up in a memo, the rest is normalised row by row.

    The memo (``known``, if one of these listings or of more is there) is persisted and counted first. One that wasn't cut holds all strings beyond ASCII, so no row leaves the JVM;
    else rows with such strings are a branch of their own, which reads the listings again.
    """
    known = memo(listings, most).persist() if known is None else known
    whole = known.count() < most
    texts = F.concat_ws(" ", "title", "company", "location")
    plain = F.octet_length(texts) == F.char_length(texts)

    # no shuffle and no fewer partitions: it ends the generated code of what made the listings, which grew too large to be compiled
    rows = (listings if whole else listings.where(plain)).coalesce(2**31 - 1)
    for kind, tagged in _tagged().items():
        rows = rows.join(known.select(F.col("tagged").alias("_tagged"), F.col("value").alias(f"_{kind}")), tagged == F.col("_tagged"), "left").drop("_tagged")
    fresh = {"title": T.normalise_title(F.col("title"), by=F.lower), "company": T.normalise_company(F.col("company"), by=F.lower), "location": T.normalise_location(F.col("location"), F.col("remote"), by=F.lower)}
    rows = rows.withColumns({f"_{kind}": F.coalesce(f"_{kind}", x) for kind, x in fresh.items()})
    rows = rows.withColumn("key_full", T.key_full(F.col("_title"), F.col("_company"), F.col("_location"))).withColumn("key", F.left("key_full", F.lit(12)))
    rows = rows.drop("_title", "_company", "_location")
    return rows if whole else rows.unionByName(T.with_keys(listings.where(~plain)))
