"""Filter specs as data: term compilation, scope resolution, matching and fingerprint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import filter_normalise

LISTS = ("titleAny", "titleNone", "companyAny", "companyNone", "locationAny", "locationNone")
MODES = ("include", "exclude", "only")
SPEC = "scope string, " + ", ".join(f"{c} array<string>" for c in LISTS) + ", remote string, maxAgeDays double"


def validate(config: dict) -> None:
    """Raise before any job starts if the config is malformed."""
    specs = {"default": config.get("default", {}), **config.get("perSource", {})}
    for scope, spec in specs.items():
        if scope != "default" and ":" not in scope:
            raise ValueError(f"{scope}: a scope is kind:ident or kind:*")
        for k, v in spec.items():
            if k in LISTS:
                if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
                    raise ValueError(f"{scope}.{k}: a list of strings is needed")
            elif k == "remote":
                if v not in MODES:
                    raise ValueError(f"{scope}.remote: one of {MODES} is needed")
            elif k == "maxAgeDays":
                if isinstance(v, bool) or not isinstance(v, int | float) or not 0 < v < float("inf"):
                    raise ValueError(f"{scope}.maxAgeDays: a positive number is needed")
            else:
                raise ValueError(f"{scope}.{k}: unknown field")


def spec_frame(spark, config: dict) -> DataFrame:
    """One row a scope; absent fields are null, an empty list stays a list."""
    validate(config)
    rows = [(scope, *[spec.get(c) for c in LISTS], spec.get("remote"), None if spec.get("maxAgeDays") is None else float(spec["maxAgeDays"])) for scope, spec in {"default": config.get("default", {}), **config.get("perSource", {})}.items()]
    return spark.createDataFrame(rows, SPEC)


def resolve(sources: DataFrame, specs: DataFrame) -> DataFrame:
    """(source_id, fields): default, then kind:*, then kind:ident, each field replaced as a whole."""
    out = sources.select("source_id", "kind", "ident")
    for name, scope in (("d", F.lit("default")), ("k", F.concat(F.col("kind"), F.lit(":*"))), ("i", F.concat_ws(":", "kind", "ident"))):
        side = specs.select(F.col("scope").alias(f"_{name}"), F.struct(*[c for c in specs.columns if c != "scope"]).alias(name))
        out = out.join(side, scope == F.col(f"_{name}"), "left").drop(f"_{name}")
    return out.select("source_id", *[F.coalesce(f"i.{c}", f"k.{c}", f"d.{c}").alias(c) for c in specs.columns if c != "scope"])


def needle(term: Column) -> Column:
    """Compiled term: a pipe at either end pins a word edge; null if nothing is left."""
    core = F.trim(filter_normalise(F.regexp_replace(F.regexp_replace(term, r"^\|", ""), r"\|\z", "")))
    edge = lambda cond: F.when(cond, " ").otherwise("")
    return F.when(core != "", F.concat(edge(term.startswith("|")), core, edge(term.endswith("|"))))


def compiled(specs: DataFrame, by: str = "source_id") -> DataFrame:
    """Specs with needles instead of terms. All lists are unpivoted at once, so folding is one pass over a column of the small table."""
    lists = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("terms")) for c in LISTS]))
    terms = specs.select(by, lists.alias("l")).select(by, "l.c", F.explode("l.terms").alias("t")).select(by, "c", needle(F.col("t")).alias("n")).where("n is not null")
    sets = terms.groupBy(by).agg(*[F.array_sort(F.collect_set(F.when(F.col("c") == c, F.col("n")))).alias(f"{c}_n") for c in LISTS])
    none = F.array().cast("array<string>")
    return specs.join(sets, by, "left").withColumns({f"{c}_n": F.coalesce(f"{c}_n", none) for c in LISTS})


def matching(listings: DataFrame, specs: DataFrame, as_of: Column) -> DataFrame:
    """Every listing with ``matches``. ``specs`` is compiled, one row a source; haystacks are normalised once a row."""
    j = listings.join(specs.withColumnRenamed("remote", "mode"), "source_id", "left")
    j = j.withColumns({f"_h_{c}": filter_normalise(F.col(c)) for c in ("title", "company", "location")})
    hit = lambda c, field: F.exists(F.coalesce(F.col(f"{field}_n"), F.array().cast("array<string>")), lambda n: F.col(f"_h_{c}").contains(n))
    return j.withColumn("matches", verdict(hit, as_of)).drop("_h_title", "_h_company", "_h_location")


def verdict(hit: Callable[[str, str], Column], as_of: Column) -> Column:
    """Whether a listing joined with its spec passes. ``hit``: of (column, list), whether the column holds a term of the list."""
    needs = lambda field: F.size(F.coalesce(F.col(field), F.array().cast("array<string>"))) > 0
    away = F.coalesce(F.col("remote"), F.lit(False))
    exempt = away & F.col("mode").isin("include", "only")
    ok = F.lit(True)
    for c in ("title", "company", "location"):
        any_of = ~needs(f"{c}Any") | hit(c, f"{c}Any")
        if c == "location":
            any_of = any_of | F.coalesce(exempt, F.lit(False))
        ok = ok & any_of & ~hit(c, f"{c}None")
    ok = ok & ~(F.coalesce(F.col("mode") == "exclude", F.lit(False)) & away) & ~(F.coalesce(F.col("mode") == "only", F.lit(False)) & ~away)
    age = (F.unix_micros(as_of) - F.unix_micros("posted_at")) / F.lit(86_400_000_000)
    return ok & F.coalesce(age <= F.col("maxAgeDays"), F.lit(True))


def fingerprint(specs: DataFrame) -> DataFrame:
    """``filter_hash`` over a compiled spec: cosmetic edits don't change it."""
    number = F.when(F.col("maxAgeDays") == F.floor("maxAgeDays"), F.floor("maxAgeDays").cast("string")).otherwise(F.col("maxAgeDays").cast("string"))
    parts = {c: F.when(F.size(f"{c}_n") > 0, F.concat(F.lit(f'["{c}",["'), F.array_join(f"{c}_n", '","'), F.lit('"]]'))) for c in LISTS}
    parts["maxAgeDays"] = F.when(F.col("maxAgeDays").isNotNull(), F.concat(F.lit('["maxAgeDays",'), number, F.lit("]")))
    parts["remote"] = F.when(F.col("remote").isNotNull(), F.concat(F.lit('["remote","'), F.col("remote"), F.lit('"]')))
    text = F.concat(F.lit("["), F.concat_ws(",", *[parts[k] for k in sorted(parts)]), F.lit("]"))
    return specs.withColumn("filter_hash", F.left(F.sha2(text, 256), F.lit(16)))
