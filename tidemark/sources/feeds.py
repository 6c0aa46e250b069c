"""Raw board feeds to listings, and snapshot quality gates.

``raw``: (source_id, page_no, ident, payload), landed text. Schemas are explicit; a payload of the wrong shape makes its source fail, never
an empty snapshot. Each mapper returns listings with ``pos``, the place in the feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import strip_html, unescape

ASHBY = "jobs array<struct<id:string,title:string,location:string,secondaryLocations:array<struct<location:string>>,department:string,publishedAt:string,isListed:boolean,isRemote:boolean,workplaceType:string,jobUrl:string,applyUrl:string,descriptionPlain:string,descriptionHtml:string>>"
GREENHOUSE = "jobs array<struct<id:string,title:string,absolute_url:string,company_name:string,updated_at:string,first_published:string,application_deadline:string,location:struct<name:string>,departments:array<struct<name:string>>,content:string>>"
LEVER = "array<struct<id:string,text:string,hostedUrl:string,createdAt:bigint,workplaceType:string,country:string,categories:struct<department:string,team:string,location:string>,descriptionPlain:string,additionalPlain:string,openingPlain:string>>"
PAGED = "offset bigint, `limit` bigint, totalFound bigint, content array<struct<id:string,name:string,company:struct<identifier:string,name:string>,releasedDate:string,location:struct<city:string,region:string,country:string,remote:boolean>,department:struct<label:string>,function:struct<label:string>>>"
PUBLIC = "maxErgebnisse bigint, stellenangebote array<struct<beruf:string,titel:string,refnr:string,arbeitsort:struct<ort:string,region:string>,arbeitgeber:string,aktuelleVeroeffentlichungsdatum:string,externeUrl:string>>"

LISTING = ("external_id", "title", "company", "location", "remote", "department", "url", "posted_at", "closes_at", "description")


def _rows(raw: DataFrame, items: Column) -> DataFrame:
    got = raw.select("source_id", "page_no", "ident", F.posexplode(items).alias("n", "j"))
    return got.withColumn("pos", F.col("page_no").cast("long") * 1_000_000 + F.col("n"))


def _listing(rows: DataFrame, **cols: Column) -> DataFrame:
    null = {"location": "string", "remote": "boolean", "department": "string", "posted_at": "timestamp", "closes_at": "timestamp", "description": "string"}
    return rows.select("source_id", "pos", *[cols.get(c, F.lit(None).cast(null.get(c, "string"))).alias(c) for c in LISTING])


def _ts(x: Column) -> Column:
    """Instant of an ISO text; without a zone it is UTC, whatever the session's zone."""
    t = F.trim(x)
    zoned = t.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$") & t.contains(":")
    return F.try_to_timestamp(F.when(zoned, t).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z"))).otherwise(F.concat(t, F.lit("Z"))))


def _filled(x: Column) -> Column:
    """Trimmed, null if blank."""
    return F.nullif(F.trim(x), F.lit(""))


def shape(raw: DataFrame, schema: str, items: str | None) -> DataFrame:
    """(source_id, status): failed if any page lacks the feed's array."""
    parsed = F.from_json("payload", schema)
    ok = (parsed if items is None else parsed[items]).isNotNull()
    return raw.groupBy("source_id").agg(F.when(F.bool_and(ok), "ok").otherwise("failed").alias("status"))


def greenhouse(raw: DataFrame) -> DataFrame:
    r = _rows(raw, F.from_json("payload", GREENHOUSE)["jobs"])
    j = F.col("j")
    return _listing(r, external_id=j["id"], title=j["title"], company=F.coalesce(F.nullif(j["company_name"], F.lit("")), F.col("ident")), location=j["location"]["name"], department=F.get(j["departments"], F.lit(0))["name"], url=j["absolute_url"], posted_at=_ts(F.coalesce(j["first_published"], j["updated_at"])), closes_at=_ts(j["application_deadline"]), description=strip_html(unescape(j["content"])))


def lever(raw: DataFrame) -> DataFrame:
    r = _rows(raw, F.from_json("payload", LEVER))
    j = F.col("j")
    text = F.array_join(F.filter(F.array(j["openingPlain"], j["descriptionPlain"], j["additionalPlain"]), lambda x: F.trim(x) != ""), "\n\n")
    return _listing(r, external_id=j["id"], title=j["text"], company=F.col("ident"), location=F.coalesce(j["categories"]["location"], j["country"]), remote=F.when(j["workplaceType"] != "", j["workplaceType"] == "remote"), department=F.coalesce(j["categories"]["department"], j["categories"]["team"]), url=j["hostedUrl"], posted_at=F.when(j["createdAt"] != 0, F.timestamp_millis(j["createdAt"])), description=F.nullif(text, F.lit("")))


def ashby(raw: DataFrame) -> DataFrame:
    r = _rows(raw, F.from_json("payload", ASHBY)["jobs"]).where(F.coalesce(F.col("j.isListed"), F.lit(True)))
    j = F.col("j")
    more = F.filter(F.transform(F.coalesce(j["secondaryLocations"], F.array().cast("array<struct<location:string>>")), lambda x: _filled(x["location"])), lambda x: x.isNotNull())
    first = _filled(j["location"])
    place = F.when(first.isNull(), F.get(more, F.lit(0))).when(F.size(more) > 0, F.concat(first, F.lit(" (+"), F.size(more).cast("string"), F.lit(" more)"))).otherwise(first)
    return _listing(r, external_id=j["id"], title=F.trim(j["title"]), company=F.col("ident"), location=place, remote=F.coalesce(j["isRemote"], F.lower(j["workplaceType"]).contains("remote")), department=j["department"], url=F.coalesce(j["jobUrl"], j["applyUrl"], F.lit("")), posted_at=_ts(j["publishedAt"]), description=F.coalesce(j["descriptionPlain"], strip_html(j["descriptionHtml"])))


def paged(raw: DataFrame) -> DataFrame:
    r = _rows(raw, F.from_json("payload", PAGED)["content"])
    j = F.col("j")
    country = _filled(j["location"]["country"])
    place = F.concat_ws(", ", _filled(j["location"]["city"]), _filled(j["location"]["region"]), F.when(F.length(country) <= 3, F.upper(country)).otherwise(country))
    return _listing(r, external_id=j["id"], title=j["name"], company=F.coalesce(F.nullif(j["company"]["name"], F.lit("")), F.col("ident")), location=F.nullif(place, F.lit("")), remote=j["location"]["remote"], department=F.coalesce(j["department"]["label"], j["function"]["label"]), url=F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("ident"), F.lit("/"), j["id"]), posted_at=_ts(j["releasedDate"]))


SECTION = "struct<text:string>"
DETAIL = f"jobAd struct<sections:struct<jobDescription:{SECTION},qualifications:{SECTION},additionalInformation:{SECTION},companyDescription:{SECTION}>>"


def with_details(listings: DataFrame, details: DataFrame) -> DataFrame:
    """``listings`` described by their detail pages, (source_id, external_id, payload): the sections in a fixed order, whatever the payload's. Listings without a page keep theirs; pages that say the same count once.

    Copies are told where the join needs the texts, so details are exchanged once, and as texts.
    """
    s = F.from_json("payload", DETAIL)["jobAd"]["sections"]
    names = ("jobDescription", "qualifications", "additionalInformation", "companyDescription")
    parts = details.select("source_id", "external_id", *[strip_html(s[n]["text"]).alias(n) for n in names])
    text = parts.select("source_id", "external_id", F.nullif(F.concat_ws("\n\n", *names), F.lit("")).alias("_text"))
    text = text.repartition("source_id", "external_id").distinct()
    return listings.join(text, ["source_id", "external_id"], "left").withColumn("description", F.coalesce("_text", "description")).select(*listings.columns)


def clean(x: Column) -> Column:
    """Trimmed; null if it says that there is nothing."""
    return F.when(~F.trim(x).isin("", "null", "undefined", "-"), F.trim(x))


def public_search(raw: DataFrame) -> DataFrame:
    r = _rows(raw, F.from_json("payload", PUBLIC)["stellenangebote"])
    j = F.col("j")
    city, region = clean(j["arbeitsort"]["ort"]), clean(j["arbeitsort"]["region"])
    place = F.when(city.isNull(), region).when(region.isNotNull() & (F.lower(region) != F.lower(city)), F.concat(city, F.lit(", "), region)).otherwise(city)
    return _listing(r, external_id=clean(j["refnr"]), title=F.coalesce(clean(j["titel"]), clean(j["beruf"]), F.lit("(ohne Titel)")), company=F.coalesce(clean(j["arbeitgeber"]), F.lit("unbekannt")), location=place, url=F.coalesce(clean(j["externeUrl"]), F.concat(F.lit("https://www.arbeitsagentur.de/jobsuche/jobdetail/"), F.url_encode(clean(j["refnr"])))), posted_at=_ts(clean(j["aktuelleVeroeffentlichungsdatum"])))


def exact_complete(pages: DataFrame, most: int = 80) -> DataFrame:
    """(source_id, status) of (source_id, page_no, total, rows): every promised row must be there, and no page before the last is empty."""
    a = pages.groupBy("source_id").agg(F.sum("rows").alias("got"), F.min_by("total", "page_no").alias("total"), F.count(F.lit(1)).alias("n"))
    return a.select("source_id", "got", "total", F.when((F.col("got") >= F.col("total")) & (F.col("n") <= most), "ok").otherwise("failed").alias("status"))


def tolerant_complete(pages: DataFrame, distinct: DataFrame, cap: int = 800) -> DataFrame:
    """Live searches may shrink while read: the least total, less 2 % or five rows, must be there; a first page without a total counts for its rows. ``distinct``: (source_id, ids)."""
    pages = pages.withColumn("total", F.coalesce("total", F.when(F.col("page_no") == F.min("page_no").over(Window.partitionBy("source_id")), F.col("rows"))))
    a = pages.groupBy("source_id").agg(F.min("total").alias("least"), F.min_by("total", "page_no").alias("first")).join(distinct, "source_id", "left")
    allowed = F.greatest(F.lit(5), F.ceil(F.col("least") * 0.02))
    ok = (F.col("first") <= cap) & (F.coalesce("ids", F.lit(0)) >= F.col("least") - allowed)
    return a.select("source_id", "least", "ids", F.when(ok, "ok").otherwise("failed").alias("status"))


def strict_rows(listings: DataFrame) -> DataFrame:
    """(source_id, bad, status): one bad row fails the batch."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    bad = blank("external_id") | blank("title") | blank("company") | ~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False))
    return listings.groupBy("source_id").agg(F.count_if(bad).alias("bad")).withColumn("status", F.when(F.col("bad") > 0, "failed").otherwise("ok"))


#: Fields of a strict row: those that must be there, and texts that may be.
REQUIRED, OPTIONAL = {"externalId": "external_id", "title": "title", "company": "company", "url": "url"}, ("location", "department", "description")


def strict(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings, violations) of a producer that can't be trusted: ``payload`` is a JSON array of objects.

    ``violations``: (source_id, page_no, pos, reason), one row for each fault; pos is null if the payload isn't an array. A source with any of them has failed, and the caller drops
    its listings as a whole. Types are checked as JSON has them: the text "true" is no boolean.
    """
    items = raw.select("source_id", "page_no", F.from_json("payload", "array<string>").alias("items"))
    shapeless = items.where("items is null").select("source_id", "page_no", F.lit(None).cast("long").alias("pos"), F.lit("not a JSON array").alias("reason"))
    rows = items.select("source_id", "page_no", F.posexplode("items").alias("n", "item")).withColumn("pos", F.col("page_no").cast("long") * 1_000_000 + F.col("n"))
    v = F.try_parse_json("item")
    every = [*REQUIRED, *OPTIONAL, "postedAt", "remote"]
    kind = {f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) for f in every}
    text = {f: F.trim(F.try_variant_get(v, f"$.{f}", "string")) for f in every}
    rows = rows.select("source_id", "page_no", "pos", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("object"), *[kind[f].alias(f"k_{f}") for f in every], *[text[f].alias(f) for f in every])
    given = lambda f: F.coalesce(~F.col(f"k_{f}").isin("VOID"), F.lit(False))
    is_text = lambda f: F.coalesce(F.col(f"k_{f}") == "STRING", F.lit(False))
    when = _ts(F.col("postedAt"))
    filled = {f: is_text(f) & (F.col(f) != "") for f in REQUIRED}
    faults = [F.when(~filled[f], F.lit(f"missing {f}")) for f in REQUIRED]
    faults.append(F.when(filled["url"] & ~F.col("url").rlike("(?i)^https?://"), F.lit("url is not http(s)")))
    faults += [F.when(given(f) & ~is_text(f), F.lit(f"{f} is not a string")) for f in OPTIONAL]
    faults.append(F.when(given("postedAt") & ~(is_text("postedAt") & when.isNotNull()), F.lit("postedAt is neither null nor a date")))
    faults.append(F.when(given("remote") & (F.coalesce("k_remote", F.lit("")) != "BOOLEAN"), F.lit("remote is not a boolean")))
    reasons = F.when(F.col("object"), F.filter(F.array(*faults), lambda x: x.isNotNull())).otherwise(F.array(F.lit("not an object")))
    found = rows.select("source_id", "page_no", "pos", F.explode(reasons).alias("reason"))
    blank = lambda f: F.nullif(f, F.lit(""))
    good = _listing(rows.where(F.col("object")), **{c: F.col(f) for f, c in REQUIRED.items()}, **{f: blank(f) for f in OPTIONAL}, remote=F.col("remote").try_cast("boolean"), posted_at=when)
    return good, found.unionByName(shapeless)
