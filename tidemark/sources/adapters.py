"""Which mapper, shape, completeness and id policy each kind of board has; landed payloads of all kinds to listings in one go."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.diff import id_dedupe
from tidemark.sources import feeds, merged


@dataclass(frozen=True)
class Adapter:
    """``items`` names the array a payload must have (None: it is one). ``complete``: an absence from the snapshot means something. ``last``: of equal ids the last row wins.

    ``total`` and ``ident``: the field that promises so many rows, and the rows' id, of a kind that is read page by page. ``tolerant``: the promise may shrink during the walk, rows may repeat,
    and a page behind the last lacks the array. ``first``: only page 0 must have the array.
    """

    kind: str
    listings: Callable[[DataFrame], DataFrame]
    schema: str
    items: str | None
    complete: bool = True
    last: bool | None = None
    total: str | None = None
    ident: str | None = None
    tolerant: bool = False
    first: bool = False


def two_feeds(raw: DataFrame) -> DataFrame:
    """A board of two feeds: page 0 is the JSON one, page 1 the XML one."""
    return merged.listings(raw.where("page_no = 0"), raw.where("page_no = 1"))


ADAPTERS = {
    a.kind: a
    for a in (
        Adapter("greenhouse", feeds.greenhouse, feeds.GREENHOUSE, "jobs"),
        Adapter("lever", feeds.lever, feeds.LEVER, None),
        Adapter("ashby", feeds.ashby, feeds.ASHBY, "jobs"),
        Adapter("smartrecruiters", feeds.paged, feeds.PAGED, "content", last=True, total="totalFound", ident="id"),
        Adapter("arbeitsagentur", feeds.public_search, feeds.PUBLIC, "stellenangebote", last=False, total="maxErgebnisse", ident="refnr", tolerant=True, first=True),
        Adapter("personio", two_feeds, merged.JSON, None, first=True),
        Adapter("browser", lambda raw: feeds.strict(raw)[0], "array<string>", None, complete=False),
    )
}


def adapter_for(kind: str) -> Adapter:
    if kind not in ADAPTERS:
        raise ValueError(f"no adapter for {kind}")
    return ADAPTERS[kind]


def listings(raw: DataFrame, kinds: tuple[str, ...] = tuple(ADAPTERS)) -> DataFrame:
    """Listings with ``kind`` of all sources' payloads, (source_id, kind, page_no, ident, payload); each kind's rows go to its own mapper."""
    out = None
    for kind in kinds:
        a = adapter_for(kind)
        rows = a.listings(raw.where(F.col("kind") == kind))
        rows = (rows if a.last is None else id_dedupe(rows, a.last)).withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


def walked(raw: DataFrame, a: Adapter) -> DataFrame:
    """(source_id, status) of kinds that are read page by page: ok if the walk brought what the pages promised."""
    p = F.from_json("payload", a.schema)
    pages = raw.select("source_id", "page_no", p[a.total].cast("long").alias("total"), F.coalesce(p[a.items], F.array().cast(a.schema.split(f"{a.items} ", 1)[1])).alias("rows"))
    sizes = pages.select("source_id", "page_no", "total", F.size("rows").cast("long").alias("rows"))
    if not a.tolerant:
        return feeds.exact_complete(sizes.withColumn("total", F.coalesce("total", F.lit(0)))).select("source_id", "status")
    ids = pages.select("source_id", F.explode("rows").alias("r")).select("source_id", feeds.clean(F.col(f"r.{a.ident}")).alias("id")).where("id is not null").distinct()
    return feeds.tolerant_complete(sizes, ids.groupBy("source_id").agg(F.count(F.lit(1)).alias("ids"))).select("source_id", "status")


def statuses(raw: DataFrame, kinds: tuple[str, ...] = tuple(ADAPTERS)) -> DataFrame:
    """(source_id, kind, status, complete): failed if a page lacks its array, a walk over pages is short of what they promise, or a strict producer's row has a fault."""
    out = None
    for kind in kinds:
        a, mine = adapter_for(kind), raw.where(F.col("kind") == kind)
        first = mine.where(F.col("page_no") == F.lit(0)) if kind == "personio" else mine
        if a.first and a.total:
            lowest = mine.groupBy("source_id").agg(F.min("page_no").alias("page_no"))
            first = mine.join(lowest, ["source_id", "page_no"], "left_semi")
        if a.items is None:  # a lone object would be read as an array of one
            first = first.withColumn("payload", F.when(F.ltrim("payload").startswith("["), F.col("payload")))
        shape = feeds.shape(first, a.schema, a.items)
        short = feeds.strict(mine)[1].select("source_id").distinct() if kind == "browser" else walked(mine, a).where("status = 'failed'").select("source_id") if a.total else None
        if short is not None:
            shape = shape.join(short.withColumn("_bad", F.lit(True)), "source_id", "left").select("source_id", F.when(F.col("_bad"), "failed").otherwise(F.col("status")).alias("status"))
        rows = shape.select("source_id", F.lit(kind).alias("kind"), "status", F.lit(a.complete).alias("complete"))
        out = rows if out is None else out.unionByName(rows)
    return out


def statuses_of(raw: DataFrame, kinds: tuple[str, ...] = tuple(ADAPTERS)) -> DataFrame:
    """(source_id, status, etag) of landed rows that may also state a status themselves (failed, not_modified): that one holds, whatever pages there are."""
    said = raw.groupBy("source_id").agg(F.min(F.when(F.col("status") != "ok", F.col("status"))).alias("_said"), F.max("etag").alias("etag"))
    got = statuses(raw.where("payload is not null"), kinds).select("source_id", "status")
    return said.join(got, "source_id", "left").select("source_id", F.coalesce("_said", "status", F.lit("failed")).alias("status"), "etag")
