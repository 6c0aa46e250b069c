"""Queries of references, scraped feeds, scoring and delivery over rows derived from the given tables, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators import diff as D
from tidemark.operators import digest as G
from tidemark.plans import fixtures as X
from tidemark.sources import feeds, refs, scraped

TYPES = ("posting_opened", "posting_closed", *D.ALERTS)


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _case(number, *values):
    out = F.lit(None).cast("string")
    for k, v in enumerate(values):
        out = F.when(number == k, v).otherwise(out)
    return out


def _doc_state(spark, d):
    """Documents as open and closed listings, scored where they are labelled."""
    i = F.col("doc_id")
    docs = X.table(spark, d, "documents").select("doc_id", F.col("text").alias("description"))
    labels = X.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.join(labels, "doc_id", "left").select(
        (i % 25).alias("source_id"), i.cast("string").alias("key"), F.when(i % 5 > 0, "open").otherwise("closed").alias("state"), "description",
        (F.col("quality") * 100 - i % 40).cast("int").alias("fit_score"), (X.as_of() - F.make_interval(hours=(i % 1000).cast("int"))).alias("posted_at"), (i % 3 > 0).alias("posted_at_exact"),
    )


def scoring_queue(spark, d):
    return D.scoring_queue(_doc_state(spark, d)).select("source_id", "key", "posted_at")


def high_fit(spark, d):
    return D.high_fit(_doc_state(spark, d), X.as_of()).select("source_id", "key", "fit_score", "age_hours")


def url_external_id(spark, d):
    site = _case(F.col("page_id") % 4, *map(F.lit, (*refs.SITES, "other")))
    return X.table(spark, d, "pages").select("page_id", scraped.external_id(site, F.col("url")).alias("external_id"))


def relative_dates(spark, d):
    e, n = X.table(spark, d, "events"), F.col("user_id") % 50
    text = _case(F.col("event_id") % 6, _text(n, " days ago"), _text("vor ", n, " Stunden"), _text(n, "+ days ago"), F.lit("Gestern"), F.date_format("ts", "yyyy-MM-dd"), _text("week ", n))
    return e.select("event_id", scraped.relative_date(text, X.as_of(X.EVENTS_AS_OF)).alias("posted_at"))


def board_refs(spark, d):
    n = F.col("s_suppkey")
    ref = _case(n % 6, _text("greenhouse:Acme-", n), _text("https://jobs.lever.co/Acme-", n, "/x?y=1"), _text("BA: Data  Engineer@Berlin+", n % 50, "~7"), _text("LinkedIn:ML+Engineer ", n, "@Bonn"), _text("https://de.indeed.com/jobs?q=dev+", n), _text("nonsense ", n))
    return refs.parse_refs(X.table(spark, d, "supplier").select("s_suppkey", ref.alias("ref"))).select("s_suppkey", "kind", "ident", "label")


def user_actions(spark, d):
    e = X.table(spark, d, "events")
    key = [(F.col("user_id") % 25).alias("source_id"), F.col("user_id").cast("string").alias("key")]
    none = lambda kind: F.lit(None).cast(kind)
    state = e.select(*key).distinct().withColumns({"claimed_by": none("string"), "claimed_at": none("timestamp"), "applied_at": none("timestamp")})
    actions = e.select(*key, F.col("ts").cast("timestamp").alias("ts"), _case(F.col("event_id") % 4, *map(F.lit, ("claim", "release", "applied", "undo"))).alias("action"), F.col("event_type").alias("user"))
    return D.apply_actions(state, actions)


def alert_quiet_split(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.lit("k").alias("key"), _case(F.col("event_id") % 7, *map(F.lit, TYPES)).alias("type"))
    state = e.where("source_id % 10 <> 0").select("source_id", "key").distinct()
    return G.split(e, state).groupBy("type", "route").agg(F.count(F.lit(1)).alias("n"))


def _pages(spark, d, extra):
    li = X.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("page_no")).agg(F.count(F.lit(1)).alias("rows"))
    return li.withColumn("total", F.sum("rows").over(Window.partitionBy("source_id")) + extra)


def completeness_exact(spark, d):
    return feeds.exact_complete(_pages(spark, d, F.when(F.col("source_id") % 3 == 0, 1).otherwise(0)))


def completeness_tolerant(spark, d):
    ids = X.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source_id")).agg(F.count_distinct("l_orderkey", "l_linenumber").alias("ids"))
    return feeds.tolerant_complete(_pages(spark, d, F.col("source_id") % 15), ids)


def seed_sources(spark, d):
    rows = X.snapshot_and_state(spark, d).persist()
    return refs.seed(X.listing_at(rows, "f"), X.state_of(X.listing_at(rows, "s")), X.as_of()).select("source_id", "key", "external_id", "state")


def remove_sources(spark, d):
    gone = X.table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").cast("long").alias("source_id"))
    return refs.without_sources(X.state(spark, d), gone).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def digest(spark, d):
    o = F.col("okey")
    first = X.first(spark, d).withColumns({"fit_score": F.when(o % 3 > 0, o % 101), "posted_at": F.coalesce("posted_at", X.as_of())})
    return G.digest(first, X.as_of(), ("source_id", "key"))


def queries():
    own = (scoring_queue, high_fit, url_external_id, relative_dates, board_refs, user_actions, alert_quiet_split, completeness_exact, completeness_tolerant, seed_sources, remove_sources, digest)
    return {f.__name__: f for f in own}


def _id_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    group = lambda p: f"nullif(regexp_extract(url, {quoted(p)}, 1), '')"
    way = lambda p: f"url_decode({group(scraped.query_param(p[6:]))})" if p.startswith("param:") else group(p)
    sites = " ".join(f"WHEN {k} THEN coalesce({', '.join(map(way, scraped.ID_PATTERNS[s]))})" for k, s in enumerate(refs.SITES))
    return f"SELECT page_id, coalesce(CASE page_id % 4 {sites} END, left(sha1(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^?#]*)', 1)), 16)) AS external_id FROM pages"


def oracle_sql() -> dict[str, str]:
    ts, at = f"TIMESTAMP '{X.AS_OF}'", f"TIMESTAMP '{X.EVENTS_AS_OF}'"
    docs = f"""WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id), s AS (SELECT doc_id % 25 AS source_id, doc_id::VARCHAR AS key, doc_id % 5 > 0 AS is_open, text AS description, (quality * 100 - doc_id % 40)::INT AS fit_score,
      {ts} - to_hours(doc_id % 1000) AS posted_at, doc_id % 3 > 0 AS exact, (doc_id % 1000)::INT AS age_hours FROM documents LEFT JOIN q USING (doc_id)) """
    kinds = ", ".join(f"'{t}'" for t in TYPES)
    alerts = ", ".join(f"'{t}'" for t in D.ALERTS)
    pages = lambda extra: f"WITH g AS (SELECT l_suppkey AS source_id, l_linenumber AS page_no, count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS ids FROM lineitem GROUP BY ALL), p AS (SELECT source_id, count(*) AS n, sum(rows)::BIGINT AS got, sum(rows)::BIGINT + {extra} AS total, sum(ids)::BIGINT AS ids FROM g GROUP BY source_id) "
    last = lambda a, b: f"max({{'ts': ts, 'action': action, 'user': event_type}}) FILTER (action IN ('{a}', '{b}'))"
    cut = lambda c, n: f"CASE WHEN length({c}) > {n} THEN left({c}, {n - 1}) || '…' ELSE {c} END"
    minutes = f"greatest(0, floor(date_diff('microsecond', coalesce(posted_at, {ts}), {ts}) / 60000000))::BIGINT"
    age = "CASE WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN (m // 60) || 'h' || CASE WHEN m % 60 > 0 THEN ' ' || (m % 60) || 'm' ELSE '' END WHEN m < 10080 THEN (m // 1440) || 'd' || CASE WHEN (m // 60) % 24 > 0 THEN ' ' || ((m // 60) % 24) || 'h' ELSE '' END ELSE (m // 1440) || 'd' END"
    line = f"coalesce('**' || fit || '**', '—') || ' · [' || {cut('title', 60)} || '](' || url || ') — ' || concat_ws(' · ', {cut('company', 32)}, coalesce({cut('location', 28)}, CASE WHEN remote THEN 'remote' END), {age}, '`#' || key || '`')"
    return {
        "scoring_queue": docs + "SELECT source_id, key, posted_at FROM s WHERE is_open AND fit_score IS NULL AND description IS NOT NULL ORDER BY posted_at DESC, source_id DESC, key DESC LIMIT 25",
        "high_fit": docs + "SELECT source_id, key, fit_score, age_hours FROM s WHERE fit_score >= 75 AND exact AND age_hours <= 48",
        "url_external_id": _id_sql(),
        "relative_dates": f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN {at} - to_days((user_id % 50)::INT) WHEN 1 THEN {at} - to_hours(user_id % 50) WHEN 3 THEN {at} - INTERVAL 1 DAY WHEN 4 THEN ts::DATE::TIMESTAMP WHEN 5 THEN {at} - to_days((user_id % 50 * 7)::INT) END AS posted_at FROM events",
        "board_refs": """WITH s AS (SELECT s_suppkey, s_suppkey % 6 AS k, s_suppkey % 50 AS km FROM supplier) SELECT s_suppkey,
          CASE WHEN k = 0 THEN 'greenhouse' WHEN k = 1 THEN 'lever' WHEN k = 2 AND km > 0 THEN 'arbeitsagentur' WHEN k IN (3, 4) THEN 'browser' END AS kind,
          CASE WHEN k IN (0, 1) THEN 'acme-' || s_suppkey WHEN k = 2 AND km > 0 THEN 'ba:data engineer@berlin+' || km || '~7' WHEN k = 3 THEN 'linkedin:ml engineer ' || s_suppkey || '@bonn' WHEN k = 4 THEN 'indeed:dev ' || s_suppkey || '@anywhere' END AS ident,
          CASE WHEN k IN (0, 1) THEN 'acme-' || s_suppkey WHEN k = 2 AND km > 0 THEN 'Data Engineer · Berlin (' || km || 'km) · ≤7d' WHEN k = 3 THEN 'linkedin: ml engineer ' || s_suppkey || ' @ bonn' WHEN k = 4 THEN 'indeed: dev ' || s_suppkey END AS label FROM s""",
        "user_actions": f"""WITH a AS (SELECT *, ['claim', 'release', 'applied', 'undo'][event_id % 4 + 1] AS action FROM events), g AS (SELECT user_id, {last("claim", "release")} AS c, {last("applied", "undo")} AS a FROM a GROUP BY user_id)
          SELECT user_id % 25 AS source_id, user_id::VARCHAR AS key, CASE WHEN c.action = 'claim' THEN c.user END AS claimed_by, CASE WHEN c.action = 'claim' THEN c.ts END AS claimed_at, CASE WHEN a.action = 'applied' THEN a.ts END AS applied_at FROM g""",
        "alert_quiet_split": f"WITH e AS (SELECT user_id, [{kinds}][event_id % 7 + 1] AS type FROM events) SELECT type, CASE WHEN user_id % 10 = 0 THEN 'orphan' WHEN type IN ({alerts}) THEN 'alert' ELSE 'quiet' END AS route, count(*) AS n FROM e GROUP BY ALL",
        "completeness_exact": pages("CASE WHEN source_id % 3 = 0 THEN 1 ELSE 0 END") + "SELECT source_id, got, total, CASE WHEN got >= total AND n <= 80 THEN 'ok' ELSE 'failed' END AS status FROM p",
        "completeness_tolerant": pages("source_id % 15") + "SELECT source_id, total AS least, ids, CASE WHEN total <= 800 AND ids >= total - greatest(5, ceil(total * 0.02)) THEN 'ok' ELSE 'failed' END AS status FROM p",
        "seed_sources": f"WITH {X.DIFF_SQL} SELECT source_id, key, f_ext AS external_id, 'open' AS state FROM changes WHERE change = 'new'",
        "remove_sources": f"WITH {X.DIFF_SQL} SELECT source_id, count(*) AS n FROM state JOIN nation ON source_id = n_nationkey WHERE n_regionkey <> 2 GROUP BY source_id",
        "digest": f"""WITH {X.KEYED_SQL}, f AS (SELECT *, CASE WHEN okey % 3 > 0 THEN okey % 101 END AS fit, {minutes} AS m FROM keyed QUALIFY row_number() OVER (PARTITION BY source_id, key ORDER BY pos) = 1),
          r AS (SELECT row_number() OVER (ORDER BY fit DESC NULLS LAST, source_id, key)::INT AS rank, {line} AS line FROM f QUALIFY rank <= 25), u AS (SELECT rank, line, sum(length(line) + 1) OVER (ORDER BY rank) AS used FROM r)
          SELECT rank, line, (SELECT count(*) FROM f) - count(*) OVER () AS remaining FROM u WHERE used <= 4056""",
    }
