import json

from tidemark.sources import feeds as S
from tidemark.sources import adapters

RAW = "source_id long, page_no int, ident string, payload string"


def raw(spark, *payloads):
    return spark.createDataFrame([(1, i, "acme", p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], RAW)


def test_mappers(spark):
    r = S.greenhouse(raw(spark, {"jobs": [{"id": 7, "title": "T", "absolute_url": "u", "company_name": "", "updated_at": "2026-07-01T09:00:00Z", "location": {"name": "Berlin"}, "departments": [{"name": "Eng"}], "content": "&lt;h2&gt;Who we are&lt;/h2&gt;&lt;p&gt;A fintech &amp;amp; co.&lt;/p&gt;"}]})).first()
    assert (r.external_id, r.company, r.location, r.department) == ("7", "acme", "Berlin", "Eng") and r.description.startswith("Who we are\n") and "fintech & co." in r.description
    r = S.lever(raw(spark, [{"id": "a", "text": "T", "hostedUrl": "u", "createdAt": 0, "workplaceType": "remote", "country": "DE", "categories": {"team": "X"}, "descriptionPlain": "d", "openingPlain": " ", "additionalPlain": "e"}])).first()
    assert (r.location, r.remote, r.department, r.posted_at, r.description) == ("DE", True, "X", None, "d\n\ne")
    rows = S.ashby(raw(spark, {"jobs": [{"id": "1", "title": " A ", "location": "Berlin", "secondaryLocations": [{"location": "Paris"}, {"location": ""}], "isRemote": None, "workplaceType": "Remote", "applyUrl": "v"}, {"id": "2", "isListed": False}]})).collect()
    assert [(r.title, r.location, r.remote, r.url) for r in rows] == [("A", "Berlin (+1 more)", True, "v")]
    r = S.paged(raw(spark, {"totalFound": 1, "content": [{"id": "9", "name": "N", "location": {"city": "Berlin", "region": " ", "country": "de"}, "function": {"label": "F"}}]})).first()
    assert (r.location, r.department, r.company) == ("Berlin, DE", "F", "acme")
    r = S.public_search(raw(spark, {"maxErgebnisse": 1, "stellenangebote": [{"beruf": "B", "titel": "null", "refnr": "10-1", "arbeitsort": {"ort": "Berlin", "region": "BERLIN"}, "arbeitgeber": "-"}]})).first()
    assert (r.title, r.company, r.location, r.external_id) == ("B", "unbekannt", "Berlin", "10-1")
    assert S.shape(raw(spark, {"ok": False}), S.ASHBY, "jobs").first().status == "failed"
    assert S.shape(raw(spark, {"jobs": []}), S.ASHBY, "jobs").first().status == "ok"


def test_completeness(spark):
    pages = spark.createDataFrame([(1, 0, 102, 100), (1, 1, 102, 2), (2, 0, 102, 100), (3, 0, 900, 900)], "source_id long, page_no int, total long, rows long")
    assert {r.source_id: r.status for r in S.exact_complete(pages).collect()} == {1: "ok", 2: "failed", 3: "ok"}
    ids = spark.createDataFrame([(1, 97), (2, 96), (3, 900)], "source_id long, ids long")
    assert {r.source_id: r.status for r in S.tolerant_complete(pages, ids).collect()} == {1: "ok", 2: "failed", 3: "failed"}


def test_walks_that_fall_short_fail(spark):
    """What each kind's pages promise is held against what they brought."""
    ads = lambda n, start=0: [{"refnr": f"r{i}", "titel": "T"} for i in range(start, start + n)]
    search = lambda total, rows: {"maxErgebnisse": total, "stellenangebote": rows}
    board = lambda total, n: {"totalFound": total, "content": [{"id": str(i), "name": "N"} for i in range(n)]}
    walks = {
        ("smartrecruiters", "ok"): [board(3, 2), board(3, 1)],
        ("smartrecruiters", "failed"): [board(500, 1)],
        ("arbeitsagentur", "ok"): [search(102, ads(100)), {"maxErgebnisse": 100}],
        ("arbeitsagentur", "failed"): [search(150, ads(100)), search(150, [])],
        ("arbeitsagentur", " failed"): [search(801, ads(801))],  # more than may be read at all
        ("arbeitsagentur", "  failed"): [search(110, ads(60)), search(110, ads(50))],  # rows that repeat count once
        ("arbeitsagentur", "   failed"): [{"maxErgebnisse": 0}],
        ("personio", "ok"): [[{"id": "1", "name": "N"}], "<workzag-jobs></workzag-jobs>"],
        ("personio", "failed"): [{"error": 1}, "<workzag-jobs></workzag-jobs>"],
        ("personio", " ok"): [[], "not xml"],
        ("greenhouse", "failed"): [{"jobs": []}, {}],
    }
    rows = [(i, n, kind, "acme", p if isinstance(p, str) else json.dumps(p), None, None) for i, ((kind, _), pages) in enumerate(walks.items()) for n, p in enumerate(pages)]
    rows += [(50, 0, "lever", "acme", None, "not_modified", "e"), (51, 0, "lever", "acme", "[]", None, None), (51, 1, "lever", "acme", None, "failed", None)]
    pages = spark.createDataFrame(rows, "source_id long, page_no int, kind string, ident string, payload string, status string, etag string")
    got = {r.source_id: (r.status, r.etag) for r in adapters.statuses_of(pages).collect()}
    assert got == {i: (want.strip(), None) for i, (_, want) in enumerate(walks)} | {50: ("not_modified", "e"), 51: ("failed", None)}
    both = [(60, 0, "personio", "acme", '[{"id": "1", "name": "A"}]'), (60, 1, "personio", "acme", "<workzag-jobs><position><id>2</id><name>B</name></position></workzag-jobs>")]
    listed = adapters.listings(spark.createDataFrame(both, "source_id long, page_no int, kind string, ident string, payload string")).orderBy("pos").collect()
    assert [(r.kind, r.external_id, r.title) for r in listed] == [("personio", "1", "A"), ("personio", "2", "B")]


def test_instants_without_a_zone_are_utc(spark):
    texts = ["2026-07-01", "2026-07-01T09:00:00", "2026-07-01T09:00:00Z", "2026-07-01T09:00:00+02:00", "2026-07-01 09:00:00.5", "no", ""]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(t,) for t in texts], "t string").select(S._ts(S.F.col("t")).cast("double").alias("s"))
        got = [r.s for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    day = 1782864000.0
    assert got == [day, day + 32400, day + 32400, day + 25200, day + 32400.5, None, None]
