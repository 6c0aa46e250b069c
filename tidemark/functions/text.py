"""Text normalisation, identity keys and small scalar functions over columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of decoration in titles, locations and company names. \b is an ASCII word edge.
GENDERS = (r"\(?\s*\ball[\s-]+genders?\b\s*\)?", r"\(?\s*\b[mwfdxagn](?:\s*[\/|]\s*[mwfdxagn]){1,3}\b\s*\)?")
REQUISITIONS = (
    r"\b(?:job\s*(?:id|code|nr\.?|no\.?)|requisition(?:\s*id)?|req(?:\.|\s|-|#|:)?|ref(?:erence)?(?:\.|\s|-|#|:)?|stellen[a-z]*nummer)\s*[:#-]?\s*[a-z]{0,4}[-\s]?\d{2,}",
    r"[\(\[]\s*#?\s*[a-z]{0,4}[-\s]?\d{3,}\s*[\)\]]",
    r"\s#\d{3,}\b",
)
EMPLOYMENT = r"\(?\s*\b(?:full[\s-]?time|part[\s-]?time|vollzeit|teilzeit|permanent|contract|festanstellung)\b\s*\)?"
URGENT = r"\(?\s*\b(?:urgent(?:ly)?(?:\s+hiring)?|hiring\s+now|immediate\s+start)\b\s*\)?"
NEWS = (r"[\(\[\{]\s*new\s*[\)\]\}]", r"^\s*new\s*[-–—:|•]+\s*", r"\s*[-–—:|•]+\s*new\s*$")
ARRANGEMENT = r"[\s\-–—|,/(\[]+\s*(?:100%\s*)?(?:fully\s+)?(?:remote|hybrid|on[\s-]?site|onsite|in[\s-]?office|wfh|work\s+from\s+home)\b[^)\]]*[\)\]]?\s*$"
REMOTE = r"\b(?:remote|wfh|work\s+from\s+home|anywhere|home[\s-]?office|telecommute)\b"
HYBRID = r"\bhybrid\b"
OFFICE = r"\b(?:office|hq|headquarters|campus|standort|buro|site)\b"
CITY_SPLIT = r"[,;/•|–—-]|\bor\b"
LEGAL = r"\s*(?:&\s*co\.?|gmbh|mbh|ug|ag|se|kg|ohg|e\.?\s?v|inc|incorporated|llc|l\.l\.c|ltd|limited|plc|corp(?:oration)?|co|company|bv|b\.v|nv|n\.v|as|a\/s|ab|oy|sa|s\.a|sas|srl|s\.r\.l|spa|pty|pte|kft|sp\.?\s?z\s?o\.?o)\.?\s*$"
SQUASH = r"[^\p{L}\p{N}+#]+"
TITLE_STEPS = (*GENDERS, *REQUISITIONS, EMPLOYMENT, URGENT, *NEWS, ARRANGEMENT, ARRANGEMENT, ARRANGEMENT)
#: Strings of which a text must hold one for a pattern to match (by pattern): a plain search spares most texts the pattern.
NEEDS = {
    GENDERS[0]: ("all",),
    GENDERS[1]: ("/", "|"),
    **{p: tuple("0123456789") for p in REQUISITIONS},
    EMPLOYMENT: ("time", "zeit", "permanent", "contract", "festanstellung"),
    URGENT: ("urgent", "hiring", "immediate"),
    **{p: ("new",) for p in NEWS},
    ARRANGEMENT: ("remote", "hybrid", "site", "office", "wfh", "home"),
    REMOTE: ("remote", "wfh", "home", "anywhere", "telecommute"),
    HYBRID: ("hybrid",),
    OFFICE: ("office", "hq", "headquarters", "campus", "standort", "buro", "site"),
}
#: Blanks that compatibility folding leaves: plain spaces here.
BLANKS = "\u1680\u2028\u2029\ufeff"
#: Markup rewrites, in this order (pattern, replacement), fixed values.
MARKUP = (
    (r"(?is)<script.*?</script>", " "),
    (r"(?is)<style.*?</style>", " "),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</(?:p|div|li|h[1-6])>", "\n"),
    (r"(?i)<li[^>]*>", "- "),
    (r"<[^>]+>", " "),
    (r"&nbsp;", " "),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
)
MARKUP_END = ((r"(?i)&[a-z]+;", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"))

_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(pattern: str) -> str:
    """The pattern with ASCII word edges and end-of-input for Java's engine."""
    out = pattern.replace(r"\b", _EDGE)
    return out[:-1] + r"\z" if out.endswith("$") else out


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, computed once however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _holds(x: Column, pattern: str) -> Column:
    return reduce(or_, [x.contains(w) for w in NEEDS[pattern]])


def _without(x: Column, patterns: tuple[str, ...]) -> Column:
    """Matches of the patterns, one after the other, become spaces. Patterns that can't match are not tried."""
    step = lambda p: lambda t: F.when(_holds(t, p), F.regexp_replace(t, java(p), " ")).otherwise(t)
    for p in patterns:
        x = _let(x, step(p))
    return x


def _folded(form: str, last: str | None):
    def fold(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            y = "".join(c for c in unicodedata.normalize(form, x) if not unicodedata.category(c).startswith("M")).lower()
            return unicodedata.normalize(last, y) if last else y

        return s.map(one, na_action="ignore")

    return fold


def fold(x: Column, last: str | None = "NFKC") -> Column:
    """De-accented, lower-case, compatibility-normalised. Only non-ASCII strings leave the JVM."""
    x = F.translate(x, BLANKS, " " * len(BLANKS))
    plain = F.octet_length(x) == F.char_length(x)
    helper = F.pandas_udf(_folded("NFKD", last), "string")
    return F.when(plain, F.lower(x)).otherwise(helper(F.when(~plain, x)))


@cache
def _images(last: str | None) -> tuple[str, str, str]:
    """(characters, their images, class of the rest): what folding makes of a character where that is at most one, whatever stands beside it.

    Characters whose image is empty come last, so ``translate`` drops them. The class holds all others that folding changes, and those that may be joined
    to the character before: a text without any is folded character by character.
    """
    fold = _folded("NFKD", last)
    every = [chr(i) for i in range(128, 0x110000) if not 0xD800 <= i <= 0xDFFF]
    images = dict(zip(every, fold(pd.Series(every)), strict=True))
    joins = {c for c in every if unicodedata.combining(c) and not unicodedata.category(c).startswith("M")}
    for c in every:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            joins.add(chr(int(parts[1], 16)))
    joins = {c for c in joins if not unicodedata.category(c).startswith("M")} | {chr(i) for i in range(0x1161, 0x1176)} | {chr(i) for i in range(0x11A8, 0x11C3)}
    rest = {c for c, to in images.items() if len(to) > 1 or joins & {c, *to}} | {"\u03a3"}  # the form of a capital sigma depends on its place
    some = {c: to for c, to in images.items() if c not in rest and c != to and c not in BLANKS} | {chr(i): chr(i + 32) for i in range(65, 91)} | dict.fromkeys(BLANKS, " ")
    full, gone = [c for c in some if some[c]], [c for c in some if not some[c]]
    codes, spans = sorted(map(ord, rest - set(BLANKS))), []
    for i in codes:
        if spans and spans[-1][1] == i - 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return "".join(full + gone), "".join(some[c] for c in full), "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def fold_mapped(x: Column, last: str | None = "NFKC") -> Column:
    """``fold`` in the JVM alone, for texts that ``needs_helper`` doesn't pick."""
    characters, images, _ = _images(last)
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, characters, images))


def needs_helper(x: Column, last: str | None = "NFKC") -> Column:
    """Whether a text holds a character that only the helper of ``fold`` folds as it should."""
    return F.coalesce((F.octet_length(x) != F.char_length(x)) & x.rlike(_images(last)[2]), F.lit(False))


def squash(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, SQUASH, " "))


#: Takes a column and gives the folded one: ``fold``, or ``fold_mapped`` for texts that need no helper.
Fold = Callable[[Column], Column]


def normalise_title(title: Column, by: Fold = fold) -> Column:
    return squash(_without(by(title), TITLE_STEPS))


def normalise_location(location: Column, remote: Column, by: Fold = fold) -> Column:
    raw = F.trim(F.coalesce(location, F.lit("")))
    flag = F.coalesce(remote, F.lit(False))
    has = lambda x, p: _holds(x, p) & x.rlike(java(p))

    def named(low: Column) -> Column:
        bare = _without(F.regexp_replace(low, r"\([^)]*\)", " "), (HYBRID, REMOTE, OFFICE))
        parts = F.filter(F.transform(F.split(bare, java(CITY_SPLIT)), squash), lambda s: s != "")
        place = F.coalesce(F.get(parts, F.lit(0)), F.when(flag & ~has(low, HYBRID), "remote").otherwise("hybrid"))
        return F.when(low == "", F.when(flag, "remote").otherwise("")).when(~has(low, HYBRID) & has(low, REMOTE), "remote").otherwise(place)

    return _let(by(raw), named)


def normalise_company(company: Column, strict_suffix: bool = False, by: Fold = fold) -> Column:
    """``strict_suffix`` asks for a blank before a legal suffix; without it glued endings go too."""
    legal = java(LEGAL)
    if strict_suffix:
        legal = legal.replace(r"\s*", r"\s+", 1)

    def cut(c: Column, passes: int) -> Column:
        """Suffixes go one at a time, until nothing changes."""
        return _let(F.regexp_replace(c, legal, ""), lambda less: F.when(less == c, less).otherwise(cut(less, passes - 1)) if passes > 1 else less)

    return squash(_let(F.regexp_replace(by(company), r"[.,]+\z", ""), lambda c: cut(c, 4)))


def key_full(title: Column, company: Column, location: Column) -> Column:
    """64 hex digits over the three normalised fields (already normalised columns)."""
    tail = F.concat(F.lit(" "), location)
    cut = F.trim(F.substring(title, F.lit(1), F.length(title) - F.length(tail)))
    t = F.when(~location.isin("", "remote") & title.endswith(tail) & (cut != ""), cut).otherwise(title)
    return F.sha2(F.concat(company, F.lit("\0"), t, F.lit("\0"), location), 256)


def with_keys(listings):
    """Add ``key_full`` and the 12-digit ``key``. Normalised fields are computed once, then hashed."""
    n = listings.withColumns({"_t": normalise_title(F.col("title")), "_c": normalise_company(F.col("company")), "_l": normalise_location(F.col("location"), F.col("remote"))})
    return n.withColumn("key_full", key_full(F.col("_t"), F.col("_c"), F.col("_l"))).withColumn("key", F.left("key_full", F.lit(12))).drop("_t", "_c", "_l")


def filter_normalise(x: Column) -> Column:
    """Form that filter terms are matched against: one space on either side."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(F.coalesce(x, F.lit("")), None), "[^a-z0-9]+", " ")), F.lit(" "))


def strip_html(html: Column) -> Column:
    """Prose of a page; null if nothing is left."""
    t = html
    for p, to in MARKUP:
        t = F.regexp_replace(t, p, to)
    number = F.pandas_udf(_numbers, "string")
    some = html.contains("#") & t.rlike(r"&#\d+;")  # no rewrite makes a number sign: most texts are told without rewriting them once more
    t = F.when(some, number(F.when(some, t))).otherwise(t)
    for p, to in MARKUP_END:
        t = F.regexp_replace(t, p, to)
    return F.nullif(F.regexp_replace(t, r"^[\s ]+|[\s ]+\z", ""), F.lit(""))


def _numbers(s: pd.Series) -> pd.Series:
    import re

    return s.map(lambda x: re.sub(r"&#(\d+);", lambda m: chr(int(m[1]) & 0xFFFF), x), na_action="ignore")


def unescape(x: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days, half up, never negative; 0 if unknown."""
    d = F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000) + 0.5)
    return F.greatest(F.lit(0), F.coalesce(d, F.lit(0))).cast("int")


def elapsed_hours(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(3_600_000_000) + 0.5).cast("int")


def age_label(at: Column, as_of: Column) -> Column:
    m = F.greatest(F.lit(0), F.floor((F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(60_000_000)).cast("long"))
    div = lambda a, n: F.call_function("div", a, F.lit(n).cast("long"))
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x), F.when(b > 0, F.concat(F.lit(" "), b.cast("string"), F.lit(y))).otherwise(""))
    h, d = div(m, 60), div(m, 1440)
    return F.when(m < 60, F.concat(m.cast("string"), F.lit("m"))).when(h < 24, two(h, "h", m % 60, "m")).when(d < 7, two(d, "d", h % 24, "h")).otherwise(F.concat(d.cast("string"), F.lit("d")))


def trunc(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most - 1)), F.lit("…"))).otherwise(x)


# ---- DuckDB equivalents, built from the same fixed values (ASCII text) ----
def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def sql_squash(x: str) -> str:
    return f"trim(regexp_replace({x}, {_q(SQUASH)}, ' ', 'g'))"


def sql_title(x: str) -> str:
    t = f"lower({x})"
    for p in TITLE_STEPS:
        t = f"regexp_replace({t}, {_q(p)}, ' ', 'g')"
    return sql_squash(t)


def sql_company(x: str) -> str:
    c = f"regexp_replace(lower({x}), '[.,]+$', '')"
    for _ in range(4):
        c = f"regexp_replace({c}, {_q(LEGAL)}, '')"
    return sql_squash(c)


def sql_location(loc: str, remote: str) -> str:
    low = f"lower(trim(coalesce({loc}, '')))"
    bare = f"regexp_replace({low}, '\\([^)]*\\)', ' ', 'g')"
    for p in (HYBRID, REMOTE, OFFICE):
        bare = f"regexp_replace({bare}, {_q(p)}, ' ', 'g')"
    city = sql_squash(f"coalesce(list_filter(string_split_regex({bare}, {_q(CITY_SPLIT)}), lambda s: {sql_squash('s')} <> '')[1], '')")
    flag, hyb = f"coalesce({remote}, false)", f"regexp_matches({low}, {_q(HYBRID)})"
    return f"CASE WHEN {low} = '' THEN CASE WHEN {flag} THEN 'remote' ELSE '' END WHEN NOT {hyb} AND regexp_matches({low}, {_q(REMOTE)}) THEN 'remote' WHEN {city} <> '' THEN {city} WHEN {flag} AND NOT {hyb} THEN 'remote' ELSE 'hybrid' END"


def sql_html(x: str) -> str:
    for p, to in (*MARKUP, *MARKUP_END):
        x = f"regexp_replace({x}, {_q(p)}, '{to}', 'g')"
    return f"nullif(regexp_replace({x}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g'), '')"
