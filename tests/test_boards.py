import json

from pyspark.sql import functions as F

from tidemark.operators import diff as D
from tidemark.operators import digest as G
from tidemark.operators import scoring as C
from tidemark.sources import merged, refs, scraped


def as_of():
    return F.lit("2026-07-10 12:00:00").cast("timestamp")


def test_two_feeds_are_merged(spark):
    raw = lambda text: spark.createDataFrame([(1, "acme", text)], "source_id long, ident string, payload string")
    page = [{"id": 1, "name": "One", "office": "Berlin", "offices": ["Berlin", " Remote "], "department": "D"}, {"id": 2, "name": "Only JSON", "office": "A, B", "offices": []}, {"id": 1, "name": "One again", "offices": ["Berlin", " Remote "]}]
    xml = """<workzag-jobs><position><id>3</id><office>Köln</office><name>Only XML</name><createdAt>2026-07-01T09:00:00+00:00</createdAt></position>
      <position><id>1</id><name>Uno</name><jobDescriptions><jobDescription><name>Tasks</name><value><![CDATA[<p>Do &amp; be</p>]]></value></jobDescription>
      <jobDescription><name>Empty</name><value> </value></jobDescription><jobDescription><name>We</name><value><![CDATA[offer]]></value></jobDescription></jobDescriptions></position></workzag-jobs>"""
    rows = {r.external_id: r for r in merged.listings(raw(json.dumps(page)), raw(xml)).collect()}
    assert [k for k, _ in sorted(rows.items(), key=lambda x: x[1].pos)] == ["1", "2", "3"]
    assert (rows["1"].title, rows["1"].location, rows["1"].remote, rows["1"].description) == ("One again", "Berlin, Remote", True, "Tasks\nDo & be\n\nWe\noffer")
    assert (rows["2"].location, rows["2"].remote, rows["2"].posted_at) == ("A, B", None, None)
    assert (rows["3"].location, rows["3"].remote, str(rows["3"].posted_at)) == ("Köln", False, "2026-07-01 09:00:00")


def test_relative_dates(spark):
    cases = {"2026-06-30T10:00": "2026-06-30 00:00:00", "Just posted": "2026-07-10 12:00:00", "gestern": "2026-07-09 12:00:00", "30+ days ago": None, "3 days ago": "2026-07-07 12:00:00", "vor 2 Stunden": "2026-07-10 10:00:00", "month 1": "2026-06-10 12:00:00", "soon": None, "": None, "99999999999999999999 days": None}
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", scraped.relative_date(F.col("t"), as_of()).cast("string").alias("d")).collect()
    assert {r.t: r.d for r in got} == cases


def test_scraped_rows(spark):
    rows = [
        ("linkedin", "https://x.linkedin.com/jobs/view/dev-at-a-77?trk=1", "T", "C", "Remote, EU"),
        ("linkedin", "https://x.linkedin.com/s?a=1&currentJobId=77", "T", "C", ""),
        ("indeed", "https://de.indeed.com/v?jk=ab%20c&jk=z#f", "T", "C", "Berlin"),
        ("stepstone", "https://s/j--123-inline.html", "T", "C", None),
        ("other", "https://h.example/p?q=1", "T", "C", None),
        ("other", "ftp://h", "T", "C", None),
        ("other", "https://h", " ", "C", None),
    ]
    df = spark.createDataFrame([(1, i, *r, None) for i, r in enumerate(rows)], "source_id long, pos long, site string, url string, title string, company string, location string, posted_text string")
    got = {r.external_id: r for r in scraped.listings(df, as_of()).collect()}
    import hashlib

    assert set(got) == {"77", "ab c", "123", hashlib.sha1(b"h.example/p").hexdigest()[:16]}
    assert got["77"].pos == 0 and got["77"].remote is True and got["ab c"].remote is None


def test_refs(spark):
    cases = {
        "greenhouse:Acme": ("greenhouse", "acme", "acme"),
        " https://job-boards.greenhouse.io/acme/jobs/1 ": ("greenhouse", "acme", "acme"),
        "jobs.eu.lever.co/x-y?z": ("lever", "x-y", "x-y"),
        "https://acme.jobs.personio.de/": ("personio", "acme", "acme"),
        "smartrecruiters:A.b_c": ("smartrecruiters", "a.b_c", "a.b_c"),
        "ba:Data  Engineer@Frankfurt am-Main+25~7": ("arbeitsagentur", "ba:data engineer@frankfurt am-main+25~7", "Data Engineer · Frankfurt Am-Main (25km) · ≤7d"),
        "ba:x+5": ("arbeitsagentur", "ba:x", "X · Deutschland"),
        "ba:x~0": (None, None, None),
        "LinkedIn: Machine_Learning+Engineer@Ｂerlin": ("browser", "linkedin:machine learning engineer@berlin", "linkedin: machine learning engineer @ berlin"),
        "indeed:a@b@c": ("browser", "indeed:a@b@c", "indeed: a@b @ c"),
        "https://de.indeed.com/jobs?l=&q=ml+engineer&where=Bonn": ("browser", "indeed:ml engineer@bonn", "indeed: ml engineer @ bonn"),
        "https://www.stepstone.de/?what=x": ("browser", "stepstone:x@anywhere", "stepstone: x"),
        "https://www.linkedin.com/jobs": (None, None, None),
        "": (None, None, None),
    }
    got = refs.parse_refs(spark.createDataFrame([(c,) for c in cases], "ref string")).collect()
    assert {r.ref: (r.kind, r.ident, r.label) for r in got} == cases


def test_board_lists_and_seeding(spark):
    lists = [{"boards": [{"ref": "lever:a", "group": "g"}, "nonsense"]}, ["lever:b", {"ref": "lever:c", "note": "n"}]]
    boards = refs.board_list(spark.createDataFrame([(json.dumps(x),) for x in lists], "payload string"))
    watched = spark.createDataFrame([("lever", "b")], "kind string, ident string")
    assert {r.ref: (r.status, r.group, r.note) for r in refs.seed_plan(boards, watched).collect()} == {"lever:a": ("new", "g", None), "nonsense": ("unknown", None, None), "lever:b": ("watched", None, None), "lever:c": ("new", None, "n")}
    cols = "source_id long, pos long, external_id string, title string, company string, location string, remote boolean, department string, url string, posted_at timestamp, closes_at timestamp, description string"
    snap = spark.createDataFrame([(1, i, f"e{i}", t, "Acme", "Berlin", None, None, "u", None, None, None) for i, t in enumerate(["Dev", "Dev (m/w/d)", "Ops"])], cols)
    none = spark.createDataFrame([], D.STATE)
    first = refs.seed(snap, none, as_of())
    assert {(r.external_id, r.state, r.posted_at_exact) for r in first.collect()} == {("e0", "open", False), ("e2", "open", False)}
    assert refs.seed(snap, first, as_of()).count() == 0
    assert refs.without_sources(first, spark.createDataFrame([(1,)], "source_id long")).count() == 0
    assert refs.seed_labels(snap, spark.createDataFrame([(1, "x"), (2, "y")], "source_id long, label string")).collect()[0] is not None


def test_scores(spark):
    cases = {'{"score": 71.5, "reason": " ok {x} "}': (72, "ok {x}"), 'say ```json\n{"score": 140}```': (100, "no reason given"), '{"score": "high"}': None, '{"score": true}': None, '{"score": NaN}': None, "none": None, '{"score": 1': None, '{"a": {"score": 3}}': None}
    got = spark.createDataFrame([(c,) for c in cases], "raw string").select("raw", C.parsed_score(F.col("raw")).alias("r")).collect()
    assert {r.raw: tuple(r.r) if r.r else None for r in got} == cases
    assert C.profile_text({"name": "N"}) is None and "N" not in C.profile_text({"name": "N", "resume": "r"})
    job = spark.createDataFrame([("T", "C", None, "spark and sql")], "title string, company string, location string, description string")
    r = job.select(C.request_text("P").alias("p"), C.overlap_score("Spark, SQL").alias("s")).first()
    assert "Location: unstated\nDescription:\nspark" in r.p and r.s.score == 67


def test_digest_budget_and_delivery(spark, tmp_path):
    cols = "seq int, fit_score int, title string, url string, company string, location string, remote boolean, posted_at string, key string"
    rows = spark.createDataFrame([(i, None if i % 3 else i, "t" * 90, "u" * 60, "c", None, i % 2 == 0, "2026-07-10 11:00:00", f"k{i}") for i in range(60)], cols).withColumn("posted_at", F.col("posted_at").cast("timestamp"))
    got = G.digest(rows, as_of()).orderBy("rank").collect()
    assert got[0].line == f"**57** · [{'t' * 59}…]({'u' * 60}) — c · 1h · `#k57`" and got[20].line.startswith("— · [")
    used = [len(r.line) + 1 for r in got]
    assert sum(used) <= 4056 < sum(used) + 190 and {r.remaining for r in got} == {60 - len(got)}
    events = spark.createDataFrame([("a", 1, "k", "stale"), ("b", 1, "k", "posting_opened"), ("c", 9, "k", "stale")], "event_id string, source_id long, key string, type string").withColumn("created_at", as_of())
    state = spark.createDataFrame([(1, "k")], "source_id long, key string")
    assert {r.event_id: r.route for r in G.split(events, state).collect()} == {"a": "alert", "b": "quiet", "c": "orphan"}
    sent, log = [], str(tmp_path / "log")
    G.deliver(G.pending(events, spark.createDataFrame([], "event_id string"), 2), lambda b: sent.extend(r.event_id for r in b.collect()), log)
    assert sent == ["a", "b"] and [r.event_id for r in G.pending(events, spark.read.parquet(log)).collect()] == ["c"]
    line = spark.createDataFrame([("x", None, True, 2, "open", None)], "claimed_by string, location string, remote boolean, repost_count int, state string, d string").withColumns({c: F.col("d").cast("timestamp") for c in ("applied_at", "closed_at")}).withColumn("closes_at", as_of())
    assert tuple(line.select(G.location_line(), G.status_line()).first()) == ("remote", "claimed by x · reposted 2× · closes 2026-07-10")
