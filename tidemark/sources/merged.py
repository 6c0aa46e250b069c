"""Boards that publish the same positions as a JSON array and as XML: one full outer join on the position's id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import strip_html
from tidemark.sources.feeds import _filled, _listing, _ts

JSON = "array<struct<id:string,name:string,office:string,offices:array<string>,department:string>>"
XML = "position array<struct<id:string,name:string,office:string,department:string,createdAt:string,jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>>>"
TEXT = "array<struct<name:string,value:string>>"


def _last(rows: DataFrame, field: str) -> DataFrame:
    """The last position of each id, at the place of the first."""
    w = Window.partitionBy("source_id", "id")
    picked = rows.withColumns({"_n": F.row_number().over(w.orderBy(F.desc("n"))), "at": F.min("n").over(w)}).where("_n = 1")
    return picked.select("source_id", "id", F.col("ident").alias(f"{field}_ident"), F.col("at").alias(f"{field}_at"), F.col("p").alias(field))


def _positions(raw: DataFrame, items: Column, field: str) -> DataFrame:
    rows = raw.select("source_id", "ident", F.posexplode(items).alias("n", "p"))
    return _last(rows.withColumn("id", _filled(F.col("p.id"))).where("id is not null"), field)


def listings(json_raw: DataFrame, xml_raw: DataFrame) -> DataFrame:
    """Listings of both feeds, (source_id, ident, payload) each; ids of the JSON feed come first, then those that only the XML has.

    JSON wins for name, office and department; the XML states dates and texts. Positions without a name go. ``feeds.shape`` with ``JSON`` tells failed sources.
    """
    j = _positions(json_raw, F.from_json("payload", JSON), "j")
    x = _described(_positions(xml_raw, F.from_xml("payload", XML)["position"], "x"))
    both = j.join(x, ["source_id", "id"], "full_outer")
    pos = F.coalesce(F.col("j_at").cast("long"), F.lit(1_000_000_000).cast("long") + F.col("x_at"))
    slug = F.coalesce("j_ident", "x_ident")
    office = F.coalesce("j.office", _filled(F.col("x.office")))
    offices = F.coalesce("j.offices", F.when(_filled(F.col("x.office")).isNotNull(), F.array(_filled(F.col("x.office")))))
    named = F.when(F.size(F.coalesce(offices, F.array().cast("array<string>"))) > 0, offices).otherwise(F.split(F.coalesce(office, F.lit("")), ","))
    place = F.array_join(F.filter(F.transform(named, lambda o: F.trim(o)), lambda o: o != ""), ", ")
    rows = both.withColumns({"title": F.coalesce("j.name", _filled(F.col("x.name"))), "pos": pos}).where("title <> ''")
    return _listing(
        rows,
        external_id=F.col("id"),
        title=F.col("title"),
        company=slug,
        location=F.nullif(place, F.lit("")),
        remote=F.when(F.size(offices) > 0, F.exists(offices, lambda o: F.lower(F.trim(o)) == "remote")),
        department=F.coalesce("j.department", _filled(F.col("x.department"))),
        url=F.concat(F.lit("https://"), slug, F.lit(".jobs.personio.de/job/"), F.col("id")),
        posted_at=_ts(_filled(F.col("x.createdAt"))),
        description=F.col("_text"),
    )


def _described(x: DataFrame) -> DataFrame:
    """XML positions with ``_text``, sections as heading and body. Exploded, since the markup helper works on columns, not inside arrays; before the feeds are joined, so each is parsed once."""
    parts = F.coalesce(F.col("x.jobDescriptions.jobDescription"), F.array().cast(TEXT))
    kept = F.struct("x_ident", "x_at", F.struct("x.name", "x.office", "x.department", "x.createdAt").alias("x"))
    s = x.select("source_id", "id", kept.alias("kept"), F.posexplode_outer(parts).alias("k", "s")).select("source_id", "id", "kept", "k", _filled(F.col("s.name")).alias("h"), strip_html(F.col("s.value")).alias("b"))
    part = F.when(F.col("b").isNotNull(), F.struct("k", F.concat_ws("\n", "h", "b").alias("t")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "\n\n")
    return s.groupBy("source_id", "id").agg(F.first("kept").alias("kept"), F.nullif(text, F.lit("")).alias("_text")).select("source_id", "id", "kept.*", "_text")
