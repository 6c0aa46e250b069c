"""Queries of the feed mappers over payloads that are built from the given tables, and their DuckDB equivalents written over the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import diff as D
from tidemark.operators import scoring as SC
from tidemark.plans import fixtures as X
from tidemark.sources import adapters, feeds, merged, refs, scraped

ORDER = ("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag")
WHEN = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _lines(spark, d):
    li = X.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag")
    part = X.table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey"))


def _ident(suppkey):
    return F.concat(F.lit("co-"), suppkey.cast("string"))


def _raw(lines, item, wrap=None):
    """One page of each supplier and line number, as the board would serve it. ``item``: of a line, the JSON object of its posting."""
    pages = _pages(lines).select("source_id", "page_no", _ident(F.col("source_id")).alias("ident"), F.transform("rows", lambda r: item(_Line(r))).alias("items"))
    return pages.select("source_id", "page_no", "ident", F.to_json("items" if wrap is None else F.struct(F.col("items").alias(wrap))).alias("payload"))


def _pages(lines):
    """(source_id, page_no, rows): bare lines in the order of their page. Objects and payloads are made of them behind the exchange, as texts are many times as wide; nothing is sorted before it."""
    bare = lines.select(F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("page_no"), *ORDER, "p_name", "p_type").repartition("source_id", "page_no")
    row = F.struct(*ORDER, F.col("page_no").alias("l_linenumber"), "p_name", "p_type")
    return bare.groupBy("source_id", "page_no").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def _struct(**fields):
    return F.struct(*[(F.lit(v) if isinstance(v, str | bool) else v).alias(k) for k, v in fields.items()])


class _Line:
    """A line, as the struct ``row`` or as the row itself: its fields, ``line % n`` (the part number modulo n), ``id`` and ``date``."""

    def __init__(self, row=None):
        self.row = row

    def __getitem__(self, name: str):
        return F.col(name) if self.row is None else self.row[name]

    def __mod__(self, n: int):
        return self["l_partkey"] % n

    @property
    def id(self):
        return F.concat_ws("-", *[self[c].cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")])

    @property
    def date(self):
        return F.date_format(self["l_shipdate"], WHEN)


P = _Line()


def _greenhouse(lines):
    job = lambda line: _struct(
        id=line.id, title=line["p_name"], absolute_url=F.concat(F.lit("https://g/"), line.id), company_name=F.when(line % 3 == 0, "").when(line % 3 == 1, "Named"), updated_at=line.date, first_published=F.when(line % 2 == 0, "2020-01-02T03:04:05Z"),
        application_deadline=F.when(line % 5 == 0, line.date), location=_struct(name=line["l_returnflag"]), departments=F.when(line % 4 > 0, F.array(_struct(name=line["p_type"]), _struct(name="second"))).otherwise(F.array().cast("array<struct<name:string>>")),
        content=F.concat(F.lit("&lt;h2&gt;Big&lt;/h2&gt;&lt;p&gt;"), line["p_name"], F.lit(" &amp;amp; co.&lt;/p&gt;")),
    )
    return _raw(lines, job, "jobs")


def _lever(lines):
    job = lambda line: _struct(
        id=line.id, text=line["p_name"], hostedUrl=F.concat(F.lit("https://l/"), line.id), createdAt=F.when(line % 3 == 0, F.lit(0)).when(line % 3 == 1, F.unix_millis(line["l_shipdate"].cast("timestamp"))), workplaceType=F.when(line % 4 == 0, "remote").when(line % 4 == 1, "").when(line % 4 == 2, "onsite"), country="DE",
        categories=_struct(department=F.when(line % 2 == 0, line["p_type"]), team="T", location=F.when(line % 5 > 0, "Berlin")), openingPlain=F.when(line % 2 == 0, " ").otherwise("open"), descriptionPlain=line["p_name"], additionalPlain=F.when(line % 7 == 0, "more"),
    )
    return _raw(lines, job)


def _ashby(lines):
    more = lambda line: F.when(line % 3 == 0, F.array(_struct(location="Paris"), _struct(location=""))).when(line % 3 == 1, F.array(_struct(location="Rome"), _struct(location="Oslo")))
    job = lambda line: _struct(
        id=line.id, title=F.concat(F.lit(" "), line["p_name"], F.lit(" ")), location=F.when(line % 5 > 0, "Berlin"), secondaryLocations=more(line), department=line["p_type"], publishedAt=line.date, isListed=F.when(line % 7 == 0, False).when(line % 7 == 1, True),
        isRemote=F.when(line % 4 == 0, True), workplaceType=F.when(line % 4 == 1, "Fully Remote").when(line % 4 == 2, "Hybrid"), jobUrl=F.when(line % 2 == 0, "https://a/job"), applyUrl=F.when(line % 6 > 0, "https://a/apply"), descriptionPlain=F.when(line % 8 == 0, "plain"), descriptionHtml="<p>html</p>",
    )
    return _raw(lines, job, "jobs")


def _paged(lines):
    job = lambda line: _struct(
        id=line.id, name=line["p_name"], company=_struct(identifier="x", name=F.when(line % 3 == 0, "").when(line % 3 == 1, "Named")), releasedDate=line.date, location=_struct(city="Berlin", region=F.when(line % 2 == 0, " ").otherwise("BE"), country=F.when(line % 3 == 0, "de").otherwise("Germany"), remote=F.when(line % 4 == 0, True)),
        department=_struct(label=F.when(line % 5 > 0, line["p_type"])), function=_struct(label="Fn"),
    )
    return _raw(lines, job, "content")


def _public(lines):
    job = lambda line: _struct(
        beruf=F.when(line % 7 > 0, "Beruf"), titel=F.when(line % 5 == 0, "null").when(line % 5 == 1, " - ").otherwise(line["p_name"]), refnr=line.id, arbeitsort=_struct(ort=F.when(line % 3 > 0, "Berlin").otherwise("undefined"), region=F.when(line % 2 == 0, "BERLIN").otherwise("Brandenburg")),
        arbeitgeber=F.when(line % 4 == 0, "-").otherwise("Firma"), aktuelleVeroeffentlichungsdatum=F.date_format(line["l_shipdate"], "yyyy-MM-dd"), externeUrl=F.when(line % 2 == 0, ""),
    )
    return _raw(lines, job, "stellenangebote")


def greenhouse_feed(spark, d):
    return feeds.greenhouse(_greenhouse(_lines(spark, d)))


def lever_feed(spark, d):
    return feeds.lever(_lever(_lines(spark, d)))


def ashby_feed(spark, d):
    return feeds.ashby(_ashby(_lines(spark, d)))


def paged_feed(spark, d):
    """Pages, described by detail pages of every other job."""
    lines = _lines(spark, d)
    text = lambda x: _struct(text=x)
    sections = _struct(companyDescription=text(F.lit("<b>us</b>")), qualifications=F.when(P % 4 == 0, text(F.lit(" "))).otherwise(text(F.lit("<li>know"))), jobDescription=text(F.concat(F.lit("<p>"), F.col("p_name"), F.lit("</p>"))))
    details = lines.where(P % 2 == 0).select(F.col("l_suppkey").alias("source_id"), P.id.alias("external_id"), F.to_json(_struct(jobAd=_struct(sections=sections))).alias("payload"))
    return feeds.with_details(feeds.paged(_paged(lines)), details)


def public_feed(spark, d):
    return feeds.public_search(_public(_lines(spark, d)))


def adapter_feeds(spark, d):
    """Five kinds of boards through the registry, ids deduped by each kind's policy."""
    lines = _lines(spark, d)
    kinds = {"greenhouse": _greenhouse, "lever": _lever, "ashby": _ashby, "smartrecruiters": _paged, "arbeitsagentur": _public}
    raw = None
    for k, (kind, build) in enumerate(kinds.items()):
        rows = build(lines.where(F.col("l_suppkey") % 5 == k)).withColumn("kind", F.lit(kind))
        raw = rows if raw is None else raw.unionByName(rows)
    return adapters.listings(raw, tuple(kinds)).select("kind", "source_id", "pos", "external_id", "title")


def walk_statuses(spark, d):
    """Walks over pages of two kinds: what every page promises is more than the walk brought at some boards, by a few rows or by many."""
    lines = _lines(spark, d)
    s = F.col("source_id")
    n = lines.groupBy(F.col("l_suppkey").alias("source_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(P.id).alias("ids"))
    total = lambda name, x: F.concat(F.lit(f'{{"{name}":'), x.cast("string"), F.lit(","), F.substring("payload", F.lit(2), F.length("payload")))
    exact = _paged(lines.where("l_suppkey % 2 = 0")).join(n, "source_id").withColumn("payload", total("totalFound", F.col("n") + F.when(s % 3 == 0, 1).otherwise(0))).withColumn("kind", F.lit("smartrecruiters"))
    loose = _public(lines.where("l_suppkey % 2 = 1")).join(n, "source_id").withColumn("payload", total("maxErgebnisse", F.col("ids") + s % 40)).withColumn("kind", F.lit("arbeitsagentur"))
    return adapters.statuses(exact.unionByName(loose), ("smartrecruiters", "arbeitsagentur"))


def payload_shapes(spark, d):
    """Suppliers whose pages lost their array fail."""
    raw = _greenhouse(_lines(spark, d))
    broken = F.when((F.col("source_id") % 7 == 0) & (F.col("page_no") == 3), '{"ok": false}').when((F.col("source_id") % 7 == 1) & (F.col("page_no") == 2), "<html>").otherwise(F.col("payload"))
    return feeds.shape(raw.withColumn("payload", broken), feeds.GREENHOUSE, "jobs")


def id_dedupes(spark, d):
    """Repeated ids of a board: the first row's values, and the last row's at the first one's place."""
    rows = X.listings(spark, d).withColumn("external_id", (F.col("okey") % 500).cast("string"))
    first = D.id_dedupe(rows).select("source_id", "external_id", "pos", "title")
    last = D.id_dedupe(rows, last=True).select("source_id", "external_id", F.col("pos").alias("last_pos"), F.col("title").alias("last_title"))
    return first.join(last, ["source_id", "external_id"])


def _strict_raw(spark, d, every=1):
    """Pages as rows of an extractor that errs, at every source or at each ``every``-th: twenty of them a source."""
    i = F.col("page_id")
    no = lambda kind: F.lit(None).cast(kind)
    bad = lambda n: (i % n == 0) & (F.floor(i / 20) % every == 0)
    title = F.when(bad(23), F.lit(" ")).otherwise(F.concat(F.lit(" T"), i.cast("string")))
    url = F.when(bad(19), F.lit("ftp://x")).otherwise(F.lit("https://x"))
    posted = F.when(bad(17), F.lit("soon")).when(i % 3 == 0, F.lit("2026-07-01")).otherwise(no("string"))
    item = F.to_json(_struct(externalId=i.cast("string"), title=title, company="C", url=url, postedAt=posted, location=F.when(i % 2 == 0, "").otherwise("Bonn")))
    item = F.when(bad(29), F.replace(item, F.lit('"company":"C"'), F.lit('"company":7'))).when(bad(31), F.replace(item, F.lit('"company"'), F.lit('"remote":"true","company"'))).when(i % 5 == 0, F.replace(item, F.lit('"company"'), F.lit('"remote":true,"company"'))).otherwise(item)
    item = F.when(bad(97), F.lit("5")).otherwise(item)
    pages = X.table(spark, d, "pages").select(F.call_function("div", i.cast("long"), F.lit(20).cast("long")).alias("source_id"), i, item.alias("item")).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("page_id", "item"))).alias("rows"))
    joined = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["item"]), ","), F.lit("]"))
    return pages.select("source_id", F.lit(0).alias("page_no"), F.lit("x").alias("ident"), F.when(F.col("source_id") % 11 == 5, "{}").otherwise(joined).alias("payload"))


def strict_violations(spark, d):
    return feeds.strict(_strict_raw(spark, d))[1].select("source_id", "pos", "reason")


def strict_listings(spark, d):
    # nearly every source has a bad row if all err, so two in three are spared
    good, bad = feeds.strict(_strict_raw(spark, d, 3))
    return good.join(bad.select("source_id").distinct(), "source_id", "left_anti").select("source_id", "pos", "external_id", "title", "location", "remote", "posted_at")


def merged_feed(spark, d):
    """The same positions as JSON and as XML, each feed lacking some."""
    lines = _lines(spark, d)
    job = lambda line: _struct(id=line.id, name=line["p_name"], office="Berlin", offices=F.when(line % 2 == 0, F.array(F.lit("Berlin"), F.lit(" Remote "))), department=F.when(line % 5 > 0, line["p_type"]))
    ids = _raw(lines.where(P % 3 > 0), job)
    # one feed a board and page: the source is both
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    position = lambda line: F.concat(F.lit("<position>"), tag("id", line.id), tag("office", F.lit("Köln")), tag("name", F.concat(F.lit("X "), line["p_name"])), tag("createdAt", line.date), F.lit("<jobDescriptions><jobDescription><name>Tasks</name><value><![CDATA[<p>Do &amp; be</p>]]></value></jobDescription></jobDescriptions></position>"))
    xml = _pages(lines.where(P % 3 < 2)).select("source_id", "page_no", _ident(F.col("source_id")).alias("ident"), F.concat(F.lit("<workzag-jobs>"), F.array_join(F.transform("rows", lambda r: position(_Line(r))), ""), F.lit("</workzag-jobs>")).alias("payload"))
    board = (F.col("source_id") * 10 + F.col("page_no")).alias("source_id")
    side = lambda df: df.select(board, "ident", "payload")
    return merged.listings(side(ids), side(xml)).select("source_id", "external_id", "title", "location", "remote", "department", "posted_at", "description")


def scraped_feed(spark, d):
    i = F.col("page_id")
    rows = X.table(spark, d, "pages").select(
        (i % 40).alias("source_id"), i.cast("long").alias("pos"), F.when(i % 2 == 0, "linkedin").otherwise("other").alias("site"), F.when(i % 2 == 0, F.concat(F.lit("https://l/jobs/view/x-"), (i % 300).cast("string"))).otherwise(F.col("url")).alias("url"),
        F.when(i % 9 == 0, " ").otherwise("T").alias("title"), F.lit(" C ").alias("company"), F.when(i % 3 == 0, "Remote, EU").when(i % 3 == 1, "").alias("location"), F.concat((i % 9).cast("string"), F.lit(" days ago")).alias("posted_text"),
    )
    return scraped.listings(rows, X.as_of()).select("source_id", "pos", "external_id", "company", "location", "remote", "posted_at")


def board_lists(spark, d):
    """Lists of boards, one a nation, in all their forms, against the boards already watched."""
    s = X.table(spark, d, "supplier")
    ref = F.concat(F.when(F.col("s_suppkey") % 4 == 0, "nonsense ").otherwise("lever:acme-"), F.col("s_suppkey").cast("string"))
    plain = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", ref.alias("ref")))).alias("rows"))
    refs_only = F.transform("rows", lambda r: r["ref"])
    objects = F.transform("rows", lambda r: F.struct(r["ref"].alias("ref"), F.lit("g").alias("group")))
    n = F.col("s_nationkey")
    payload = F.when(n % 3 == 0, F.to_json(refs_only)).when(n % 3 == 1, F.to_json(objects)).otherwise(F.to_json(F.struct(objects.alias("boards"))))
    watched = s.where("s_suppkey % 6 = 1").select(F.lit("lever").alias("kind"), F.concat(F.lit("acme-"), F.col("s_suppkey").cast("string")).alias("ident"))
    return refs.seed_plan(refs.board_list(plain.select(payload.alias("payload"))), watched).select("ref", "status", "group")


def scoring_requests(spark, d):
    i = F.col("doc_id")
    jobs = X.table(spark, d, "documents").select("doc_id", F.concat(F.lit("T"), i.cast("string")).alias("title"), F.lit("C").alias("company"), F.when(i % 2 == 0, "Bonn").alias("location"), F.when(i % 5 > 0, F.col("text")).alias("description"))
    return jobs.select("doc_id", F.sha2(SC.request_text("P", "Rate."), 256).alias("prompt_sha256"))


def folded_titles(spark, d):
    """Whole documents, folded."""
    return X.table(spark, d, "documents").select("doc_id", F.sha2(T.fold(F.coalesce("text", F.lit(""))), 256).alias("folded_sha256"))


def unescaped(spark, d):
    return X.table(spark, d, "pages").select("page_id", F.sha2(F.coalesce(T.unescape(F.col("html")), F.lit("")), 256).alias("html_sha256"))


OWN = (greenhouse_feed, lever_feed, ashby_feed, paged_feed, public_feed, adapter_feeds, walk_statuses, payload_shapes, id_dedupes, strict_violations, strict_listings, merged_feed, scraped_feed, board_lists, scoring_requests, folded_titles, unescaped)


def queries():
    return {f.__name__: f for f in OWN}


def oracle_sql() -> dict[str, str]:
    ts = f"TIMESTAMP '{X.AS_OF}'"
    lines = "WITH l AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id, 'co-' || l_suppkey AS ident, l_partkey AS p, l_linenumber * 1000000 + row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_shipdate, l_returnflag) - 1 AS pos FROM lineitem JOIN part ON l_partkey = p_partkey) "
    none = "NULL::BOOLEAN AS remote"
    day = "l_shipdate::TIMESTAMP"
    head = "SELECT l_suppkey AS source_id, pos::BIGINT AS pos, id AS external_id, "
    kinds = {
        "greenhouse_feed": "p_name AS title, CASE WHEN p % 3 = 1 THEN 'Named' ELSE ident END AS company, l_returnflag AS location, " + none + f", CASE WHEN p % 4 > 0 THEN p_type END AS department, 'https://g/' || id AS url, CASE WHEN p % 2 = 0 THEN TIMESTAMP '2020-01-02 03:04:05' ELSE {day} END AS posted_at, CASE WHEN p % 5 = 0 THEN {day} END AS closes_at, 'Big' || chr(10) || ' ' || p_name || ' & co.' AS description FROM l",
        "lever_feed": f"p_name AS title, ident AS company, CASE WHEN p % 5 > 0 THEN 'Berlin' ELSE 'DE' END AS location, CASE p % 4 WHEN 0 THEN true WHEN 2 THEN false END AS remote, CASE WHEN p % 2 = 0 THEN p_type ELSE 'T' END AS department, 'https://l/' || id AS url, CASE WHEN p % 3 = 1 THEN {day} END AS posted_at, NULL::TIMESTAMP AS closes_at, concat_ws(chr(10) || chr(10), CASE WHEN p % 2 = 1 THEN 'open' END, p_name, CASE WHEN p % 7 = 0 THEN 'more' END) AS description FROM l",
        "ashby_feed": f"p_name AS title, ident AS company, CASE WHEN p % 5 = 0 THEN CASE p % 3 WHEN 0 THEN 'Paris' WHEN 1 THEN 'Rome' END WHEN p % 3 = 0 THEN 'Berlin (+1 more)' WHEN p % 3 = 1 THEN 'Berlin (+2 more)' ELSE 'Berlin' END AS location, CASE p % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS remote, p_type AS department, CASE WHEN p % 2 = 0 THEN 'https://a/job' WHEN p % 6 > 0 THEN 'https://a/apply' ELSE '' END AS url, {day} AS posted_at, NULL::TIMESTAMP AS closes_at, CASE WHEN p % 8 = 0 THEN 'plain' ELSE 'html' END AS description FROM l WHERE p % 7 <> 0",
        "paged_feed": f"p_name AS title, CASE WHEN p % 3 = 1 THEN 'Named' ELSE ident END AS company, 'Berlin' || CASE WHEN p % 2 = 0 THEN '' ELSE ', BE' END || CASE WHEN p % 3 = 0 THEN ', DE' ELSE ', Germany' END AS location, CASE WHEN p % 4 = 0 THEN true END AS remote, CASE WHEN p % 5 > 0 THEN p_type ELSE 'Fn' END AS department, 'https://jobs.smartrecruiters.com/' || ident || '/' || id AS url, {day} AS posted_at, NULL::TIMESTAMP AS closes_at, CASE WHEN p % 2 = 0 THEN concat_ws(chr(10) || chr(10), p_name, CASE WHEN p % 4 <> 0 THEN '- know' END, 'us') END AS description FROM l",
        "public_feed": f"CASE WHEN p % 5 > 1 THEN p_name WHEN p % 7 > 0 THEN 'Beruf' ELSE '(ohne Titel)' END AS title, CASE WHEN p % 4 = 0 THEN 'unbekannt' ELSE 'Firma' END AS company, CASE WHEN p % 3 = 0 THEN CASE WHEN p % 2 = 0 THEN 'BERLIN' ELSE 'Brandenburg' END WHEN p % 2 = 0 THEN 'Berlin' ELSE 'Berlin, Brandenburg' END AS location, {none}, NULL::VARCHAR AS department, 'https://www.arbeitsagentur.de/jobsuche/jobdetail/' || id AS url, date_trunc('day', {day}) AS posted_at, NULL::TIMESTAMP AS closes_at, NULL::VARCHAR AS description FROM l",
    }
    out = {k: lines + head + v for k, v in kinds.items()}
    names = ("greenhouse", "lever", "ashby", "smartrecruiters", "arbeitsagentur")
    each = " UNION ALL ".join(f"SELECT '{kind}' AS kind, source_id, pos, external_id, title FROM ({out[q]}) WHERE source_id % 5 = {k}" if k < 3 else f"SELECT '{kind}', source_id, min(pos), external_id, min(title) FROM ({out[q]}) WHERE source_id % 5 = {k} GROUP BY source_id, external_id" for k, (kind, q) in enumerate(zip(names, kinds, strict=True)))
    faults = """SELECT page_id // 20 AS source_id, (page_id - 20 * (page_id // 20))::BIGINT AS pos, page_id AS i FROM pages WHERE (page_id // 20) % 11 <> 5"""
    reason = lambda cond, text, err: f"SELECT source_id, pos, '{text}' AS reason FROM f WHERE i % 97 <> 0{err} AND {cond}"
    faulty = lambda err="": f"WITH f AS ({faults}), v AS (SELECT source_id, pos, 'not an object' AS reason FROM f WHERE i % 97 = 0{err} UNION ALL " + " UNION ALL ".join([reason("i % 23 = 0", "missing title", err), reason("i % 29 = 0", "missing company", err), reason("i % 19 = 0", "url is not http(s)", err), reason("i % 17 = 0", "postedAt is neither null nor a date", err), reason("i % 31 = 0 AND i % 29 <> 0", "remote is not a boolean", err)]) + " UNION ALL SELECT DISTINCT page_id // 20, NULL::BIGINT, 'not a JSON array' FROM pages WHERE (page_id // 20) % 11 = 5) "
    return out | {
        "adapter_feeds": each,
        "walk_statuses": """WITH n AS (SELECT l_suppkey AS s, count(*) AS n, count(DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey)) AS ids FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey)
          SELECT s AS source_id, CASE WHEN s % 2 = 0 THEN 'smartrecruiters' ELSE 'arbeitsagentur' END AS kind, CASE WHEN s % 2 = 0 THEN CASE WHEN s % 3 = 0 THEN 'failed' ELSE 'ok' END
          WHEN ids + s % 40 <= 800 AND s % 40 <= greatest(5, ceil((ids + s % 40) * 0.02)) THEN 'ok' ELSE 'failed' END AS status, true AS complete FROM n""",
        "payload_shapes": "SELECT l_suppkey AS source_id, CASE WHEN l_suppkey % 7 = 0 AND bool_or(l_linenumber = 3) OR l_suppkey % 7 = 1 AND bool_or(l_linenumber = 2) THEN 'failed' ELSE 'ok' END AS status FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey",
        "id_dedupes": f"WITH l AS ({X.LISTINGS_SQL}) SELECT source_id, (okey % 500)::VARCHAR AS external_id, min(pos) AS pos, arg_min(title, pos) AS title, min(pos) AS last_pos, arg_max(title, pos) AS last_title FROM l GROUP BY source_id, okey % 500",
        "strict_violations": faulty() + "SELECT * FROM v",
        "strict_listings": faulty(" AND source_id % 3 = 0")
        + "SELECT source_id, pos, i::VARCHAR AS external_id, 'T' || i AS title, CASE WHEN i % 2 = 1 THEN 'Bonn' END AS location, CASE WHEN i % 5 = 0 THEN true END AS remote, CASE WHEN i % 3 = 0 THEN TIMESTAMP '2026-07-01' END AS posted_at FROM f ANTI JOIN v USING (source_id)",
        "merged_feed": lines
        + f"SELECT l_suppkey * 10 + l_linenumber AS source_id, id AS external_id, CASE WHEN p % 3 > 0 THEN p_name ELSE 'X ' || p_name END AS title, CASE WHEN p % 3 = 0 THEN 'Köln' WHEN p % 2 = 0 THEN 'Berlin, Remote' WHEN p % 3 = 1 THEN 'Köln' ELSE 'Berlin' END AS location, CASE WHEN p % 3 = 0 THEN false WHEN p % 2 = 0 THEN true WHEN p % 3 = 1 THEN false END AS remote, CASE WHEN p % 3 > 0 AND p % 5 > 0 THEN p_type END AS department, CASE WHEN p % 3 < 2 THEN {day} END AS posted_at, CASE WHEN p % 3 < 2 THEN 'Tasks' || chr(10) || 'Do & be' END AS description FROM l QUALIFY row_number() OVER (PARTITION BY l_suppkey, id ORDER BY l_shipdate DESC) = 1",
        "scraped_feed": f"""WITH s AS (SELECT page_id % 40 AS source_id, page_id::BIGINT AS pos, CASE WHEN page_id % 2 = 0 THEN (page_id % 300)::VARCHAR ELSE left(sha1(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^?#]*)', 1)), 16) END AS external_id, page_id AS i, url FROM pages WHERE page_id % 9 <> 0 AND (page_id % 2 = 0 OR starts_with(trim(url), 'http')))
          SELECT source_id, pos, external_id, 'C' AS company, CASE WHEN i % 3 = 0 THEN 'Remote, EU' END AS location, CASE WHEN i % 3 = 0 THEN true END AS remote, {ts} - to_days((i % 9)::INT) AS posted_at FROM s QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY pos) = 1""",
        "board_lists": "SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'nonsense ' ELSE 'lever:acme-' END || s_suppkey AS ref, CASE WHEN s_suppkey % 4 = 0 THEN 'unknown' WHEN s_suppkey % 6 = 1 THEN 'watched' ELSE 'new' END AS status, CASE WHEN s_nationkey % 3 > 0 THEN 'g' END AS \"group\" FROM supplier",
        "scoring_requests": "SELECT doc_id, sha256(concat('Rate.', chr(10), chr(10), 'PROFILE', chr(10), 'P', chr(10), chr(10), 'JOB', chr(10), 'Title: T', doc_id, chr(10), 'Company: C', chr(10), 'Location: ', CASE WHEN doc_id % 2 = 0 THEN 'Bonn' ELSE 'unstated' END, chr(10), 'Description:', chr(10), CASE WHEN doc_id % 5 > 0 THEN left(coalesce(text, ''), 6000) ELSE '' END)) AS prompt_sha256 FROM documents",
        "folded_titles": "SELECT doc_id, sha256(lower(strip_accents(coalesce(text, '')))) AS folded_sha256 FROM documents",
        "unescaped": """SELECT page_id, sha256(replace(replace(replace(replace(replace(coalesce(html, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS html_sha256 FROM pages""",
    }
