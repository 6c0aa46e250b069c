"""Scraped search results to listings: external ids from urls and dates from relative wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of relative dates, and the seconds of a unit.
UNIT_SECONDS = {
    60: ("minute", "minuten", "min"),
    3_600: ("hour", "hours", "stunde", "stunden", "std"),
    86_400: ("day", "days", "tag", "tagen", "jour", "jours"),
    604_800: ("week", "weeks", "woche", "wochen"),
    2_592_000: ("month", "months", "monat", "monaten"),
}
NOW_WORDS = ("just posted", "just now", "today", "heute", "gerade", "neu", "aujourd'hui", "hace instantes")
YESTERDAY_WORDS = ("yesterday", "gestern", "hier")
WORD = "[a-zä-ü']+"
# Where each site's urls carry their job id, best first.
ID_PATTERNS = {
    "linkedin": ("param:currentJobId", "param:jobId", r"/jobs/view/(?:[^/]*-)?(\d+)"),
    "indeed": ("param:jk", "param:vjk"),
    "stepstone": (r"--(\d+)-", r"/(\d{6,})(?:[/?]|$)"),
}


def query_param(name: str) -> str:
    """Pattern of the first non-empty value of a query parameter."""
    return rf"^[^?#]*\?(?:[^#]*?&)??{name}=([^&#]+)"


def _first_group(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def external_id(site: Column, url: Column) -> Column:
    """The site's own id in the url, else 16 digits of the hash of host and path."""
    found = F.lit(None).cast("string")
    for name, patterns in ID_PATTERNS.items():
        ways = []
        for p in patterns:
            if p.startswith("param:"):
                ways.append(F.try_url_decode(_first_group(url, query_param(p[6:]))))
            else:
                ways.append(_first_group(url, p))
        found = F.when(site == name, F.coalesce(*ways)).otherwise(found)
    return F.coalesce(found, F.left(F.sha1(F.encode(host_and_path(url), "UTF-8")), F.lit(16)))


def host_and_path(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), r"^(?://)?([^?#]*)", 1)


def relative_date(text: Column, as_of: Column) -> Column:
    """Timestamp of wording such as "3 days ago"; null for open-ended or unknown wording."""
    t = F.lower(F.trim(text))
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))
    ahead, behind = rf"(\d+)\s*({WORD})", rf"({WORD})\s*(\d+)"
    number = F.coalesce(_first_group(t, ahead), F.nullif(F.regexp_extract(t, behind, 2), F.lit("")))
    word = F.coalesce(F.nullif(F.regexp_extract(t, ahead, 2), F.lit("")), F.regexp_extract(t, behind, 1))
    units = F.create_map(*[F.lit(x) for seconds, words in UNIT_SECONDS.items() for w in words for x in (w, seconds)])
    seconds = F.coalesce(F.try_element_at(units, F.regexp_replace(word, r"s+\z", "")), F.try_element_at(units, word)).cast("long")
    back = F.try_multiply(F.try_multiply(number.try_cast("bigint"), seconds), F.lit(1_000_000).cast("long"))
    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("timestamp"))
        .when(iso != "", F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")))
        .when(any_of(NOW_WORDS), as_of)
        .when(any_of(YESTERDAY_WORDS), as_of - F.make_interval(days=F.lit(1)))
        .when(F.contains(t, F.lit("+")), F.lit(None).cast("timestamp"))
        .otherwise(F.timestamp_micros(F.try_subtract(F.unix_micros(as_of), back)))
    )


def listings(rows: DataFrame, as_of: Column) -> DataFrame:
    """Listings of (source_id, pos, site, url, title, company, location, posted_text).

    Rows without an http url, title or company go; the first row of an external id stays. Such sources are never complete.
    """
    tidy = rows.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("url", "title", "company", "location")})
    good = tidy.where(F.startswith("url", F.lit("http")) & (F.col("title") != "") & (F.col("company") != ""))
    ids = good.withColumn("external_id", external_id(F.col("site"), F.col("url")))
    nth = F.row_number().over(Window.partitionBy("source_id", "external_id").orderBy("pos"))
    once = ids.withColumn("_nth", nth).where("_nth = 1")
    return once.select(
        "source_id", "pos", "external_id", "title", "company", F.nullif("location", F.lit("")).alias("location"),
        F.when(F.col("location").rlike(r"(?i)(?<![A-Za-z0-9_])remote(?![A-Za-z0-9_])"), True).alias("remote"),
        F.lit(None).cast("string").alias("department"), "url", relative_date(F.col("posted_text"), as_of).alias("posted_at"),
        F.lit(None).cast("timestamp").alias("closes_at"), F.lit(None).cast("string").alias("description"),
    )
