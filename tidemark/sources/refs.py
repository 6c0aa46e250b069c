"""Board references: from what people type to (kind, ident, label), board lists, silent seeding and removal of sources."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import diff as D
from tidemark.sources.scraped import query_param

# Boards with one slug, as (kind, slug, url before the slug, url after it).
SLUG, DOTTED = "[a-z0-9][a-z0-9-]*", "[a-z0-9][a-z0-9._-]*"
BOARDS = (
    ("greenhouse", SLUG, r"(?:boards|job-boards)\.greenhouse\.io/", ""),
    ("lever", SLUG, r"jobs\.(?:eu\.)?lever\.co/", ""),
    ("ashby", SLUG, r"jobs\.ashbyhq\.com/", ""),
    ("personio", SLUG, "", r"\.jobs\.personio\.(?:de|com)"),
    ("smartrecruiters", DOTTED, r"(?:jobs|careers)\.smartrecruiters\.com/", ""),
)
SITES = ("linkedin", "indeed", "stepstone")
QUERY_PARAMS = ("keywords", "q", "what", "ke", "text")
LOCATION_PARAMS = ("location", "l", "where", "ws", "geoLocation")
REF = "struct<kind:string,ident:string,label:string>"


def _group(x: Column, pattern: str, n: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, n), F.lit(""))


def _ref(kind, ident: Column, label: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(ident.isNotNull(), F.struct(kind.alias("kind"), ident.alias("ident"), label.alias("label")))


def title_case(x: Column) -> Column:
    """Upper case after the start, a blank or a hyphen; other letters stay."""
    up = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))
    each = lambda y, sep: F.array_join(F.transform(F.split(y, sep), up), sep)
    return each(each(x, " "), "-")


def collapsed(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(x), r"\s+", " ")))


def canonical(x: Column) -> Column:
    """Compatibility form with plus and underscore as blanks, collapsed and lower-cased. Only non-ASCII strings leave the JVM."""
    plain = x.rlike(r"^\p{ASCII}*\z")
    form = F.pandas_udf(_compatible, "string")
    return collapsed(F.regexp_replace(F.when(plain, x).otherwise(form(F.when(~plain, x))), "[+_]+", " "))


def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def board_ref(x: Column) -> Column:
    ways = []
    for kind, slug, before, after in BOARDS:
        ident = F.lower(F.coalesce(_group(x, rf"(?i)^{kind}:({slug})\z"), _group(x, rf"(?i)^(?:https?://)?{before}({slug}){after}(?:[/?].*)?\z")))
        ways.append(_ref(kind, ident, ident))
    return F.coalesce(*ways)


def search_ref(x: Column) -> Column:
    """``query[@location[+radius]][~days]``; a radius without a location goes, a zero radius or zero days don't match."""
    rest = F.trim(_group(x, r"(?i)^(?:arbeitsagentur|ba):(.+)\z"))
    days = _group(rest, r"~(\d{1,3})\z").cast("int")
    rest = F.regexp_replace(rest, r"~\d{1,3}\z", "")
    radius = _group(rest, r"\+(\d{1,3})\z").cast("int")
    rest = F.regexp_replace(rest, r"\+\d{1,3}\z", "")
    query = F.nullif(collapsed(F.substring_index(rest, "@", 1)), F.lit(""))
    place = F.nullif(collapsed(_group(rest, "^[^@]*@(.*)")), F.lit(""))
    far, since = F.when(place.isNotNull(), radius).cast("string"), days.cast("string")
    tag = lambda a, v, b="": F.coalesce(F.concat(F.lit(a), v, F.lit(b)), F.lit(""))
    ok = (F.coalesce(days, F.lit(1)) > 0) & (F.coalesce(radius, F.lit(1)) > 0)
    ident = F.when(ok, F.concat(F.lit("ba:"), query, tag("@", place), tag("+", far), tag("~", since)))
    where = F.coalesce(F.concat(title_case(place), tag(" (", far, "km)")), F.lit("Deutschland"))
    return _ref("arbeitsagentur", ident, F.concat_ws(" · ", title_case(query), where, F.concat(F.lit("≤"), since, F.lit("d"))))


def scraped_parts(x: Column) -> Column:
    """struct(site, query, place) of a prefixed search or a pasted results url, as typed."""
    typed = rf"(?is)^({'|'.join(SITES)})\s*:\s*(.+)\z"
    body = _group(x, typed, 2)
    at = body.contains("@")
    place = F.when(at, F.substring_index(body, "@", -1)).otherwise("")
    query = F.when(at, F.substring(body, F.lit(1), F.length(body) - F.length(place) - 1)).otherwise(body)
    host = F.lower(_group(x, "(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)"))
    site = F.lit(None).cast("string")
    for name in reversed(SITES):
        site = F.when(host.contains(f"{name}."), name).otherwise(site)
    pick = lambda names: F.coalesce(*[_blank_free(F.try_url_decode(_group(x, query_param(n)))) for n in names], F.lit(""))
    shape = lambda s, q, p: F.struct(s.alias("site"), q.alias("query"), p.alias("place"))
    return F.when(body.isNotNull(), shape(F.lower(_group(x, typed)), query, place)).when(site.isNotNull(), shape(site, pick(QUERY_PARAMS), pick(LOCATION_PARAMS)))


def _blank_free(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def parse_refs(refs: DataFrame, column: str = "ref") -> DataFrame:
    """``refs`` with ``kind``, ``ident`` and ``label``, all null where nothing fits; the first form that fits wins."""
    x = F.trim(F.col(column))
    # one projection each: the canonical form is a batched helper over plain columns
    a = refs.withColumns({"_typed": F.coalesce(board_ref(x), search_ref(x)), "_s": scraped_parts(x)})
    b = a.withColumns({"_q": canonical(F.col("_s.query")), "_p": canonical(F.col("_s.place"))})
    q = F.nullif("_q", F.lit(""))
    ident = F.concat(F.col("_s.site"), F.lit(":"), q, F.lit("@"), F.when(F.col("_p") != "", F.col("_p")).otherwise("anywhere"))
    label = F.concat(F.col("_s.site"), F.lit(": "), q, F.when(F.col("_p") != "", F.concat(F.lit(" @ "), F.col("_p"))).otherwise(""))
    out = b.withColumn("_r", F.coalesce("_typed", _ref("browser", ident, label)))
    return out.select(*[c for c in refs.columns if c not in ("kind", "ident", "label")], "_r.kind", "_r.ident", "_r.label")


def board_list(payloads: DataFrame) -> DataFrame:
    """(payload_pos, ref, group, note) of JSON lists: ``{"boards": [..]}`` or an array, of objects or of plain strings."""
    items = F.coalesce(F.from_json("payload", "boards array<string>")["boards"], F.from_json("payload", "array<string>"))
    e = payloads.select(F.posexplode(items).alias("payload_pos", "e"))
    o = F.from_json("e", "ref string, `group` string, note string")
    plain = ~F.startswith("e", F.lit("{"))
    return e.select("payload_pos", F.when(plain, F.col("e")).otherwise(o["ref"]).alias("ref"), F.when(~plain, o["group"]).alias("group"), F.when(~plain, o["note"]).alias("note"))


def seed_plan(boards: DataFrame, sources: DataFrame) -> DataFrame:
    """Parsed boards with ``status``: unknown, watched or new."""
    known = sources.select("kind", "ident").distinct().withColumn("_known", F.lit(True))
    j = parse_refs(boards).join(known, ["kind", "ident"], "left")
    return j.withColumn("status", F.when(F.col("kind").isNull(), "unknown").when(F.col("_known"), "watched").otherwise("new")).drop("_known")


def seed(listings: DataFrame, state: DataFrame, as_of: Column) -> DataFrame:
    """State rows to add for the first snapshot of a source: one a key, none that is stored already, and no events."""
    changes = D.diff(D.first_wins(listings), state).where("change = 'new'")
    return D.roll_forward(changes.withColumns({"accepted": F.lit(True), "may_close": F.lit(False)}), as_of)


def seed_labels(listings: DataFrame, parsed: DataFrame) -> DataFrame:
    """(source_id, label): the first listing's company, else the parsed label."""
    first = listings.groupBy("source_id").agg(F.min_by("company", "pos").alias("company"))
    return parsed.select("source_id", "label").join(first, "source_id", "left").select("source_id", F.coalesce(F.nullif("company", F.lit("")), "label").alias("label"))


def seed_yield(matched: DataFrame) -> DataFrame:
    """(source_id, total, matched): a dry run over listings with ``matches``."""
    return matched.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("matches").alias("matched"))


def without_sources(table: DataFrame, removed: DataFrame) -> DataFrame:
    """State or events without the removed sources."""
    return table.join(removed.select("source_id"), "source_id", "left_anti")
