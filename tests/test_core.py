import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import text as T
from tidemark.operators import diff as D
from tidemark.operators import filters as FL

SF = "/root/testdata/sf0.001"
def now():
    return F.lit("2026-07-30 00:00:00").cast("timestamp")


LISTING = "source_id long, pos long, external_id string, title string, company string, location string, remote boolean, department string, url string, posted_at timestamp, closes_at timestamp, description string"

# One decorated form after the other of a few plain titles; every rule has a case of its own, and one that looks like it but isn't.
TITLES = {
    "pastry chef": ["Pastry Chef", "PASTRY  CHEF", "Pastry Chef (w/m/x)", "Pastry Chef d|f|m", "(All Genders) Pastry Chef", "Pastry Chef, all gender"],
    "night porter": ["Night Porter Part-Time", "Teilzeit: Night Porter", "Night Porter (Festanstellung)", "Contract Night Porter"],
    "crane driver": ["Urgently hiring: Crane Driver", "Immediate Start Crane Driver", "{new} Crane Driver", "new | Crane Driver", "Crane Driver - NEW"],
    "renewal clerk": ["Renewal Clerk"],
    "tax adviser": ["Tax Adviser Ref: AB-9012", "Tax Adviser [#4711]", "Requisition ID 77 Tax Adviser", "Tax Adviser #900", "Tax Adviser Stellennummer 31"],
    "ship cook": ["Ship Cook, on-site", "Ship Cook (100% remote)", "Ship Cook | WFH", "Ship Cook – Hybrid – Remote", "Ship Cook [In Office]"],
    "remote sensing analyst": ["Remote Sensing Analyst"],
    "c++ developer": ["C++ Developer"],
    "garcon de cafe": ["Garçon de Café"],
    "straßenbauer": ["Straßenbauer"],
}
PLACES = [("Lyon; Nantes", None, "lyon"), ("Ålesund", False, "alesund"), ("Home-Office", None, "remote"), ("Hybrid (Porto)", None, "hybrid"), ("Porto or Faro", None, "porto"), (" ", True, "remote"), ("(UK)", True, "remote"), ("Graz HQ", None, "graz"), ("anywhere/hybrid", True, "hybrid"), ("Standort Ulm | Bonn", None, "ulm")]
FIRMS = [("Nordwind Logistik GmbH.", "nordwind logistik"), ("Blue Kite Pty Ltd", "blue kite"), ("Inc Magazine", "inc magazine"), ("Öl & Co", "ol"), ("Vega S.A.", "vega"), ("Ltd", ""), ("Tabasco", "t"), ("Monaco", "mona")]


def test_normalised_forms(spark):
    rows = [(t, want) for want, ts in TITLES.items() for t in ts]
    for r in spark.createDataFrame(rows, "t string, w string").withColumn("g", T.normalise_title(F.col("t"))).collect():
        assert r.g == r.w, r.t
    for r in spark.createDataFrame(PLACES, "l string, r boolean, w string").withColumn("g", T.normalise_location(F.col("l"), F.col("r"))).collect():
        assert r.g == r.w, r.l
    for r in spark.createDataFrame(FIRMS, "c string, w string").withColumn("g", T.normalise_company(F.col("c"))).collect():
        assert r.g == r.w, r.c


def board(titles, source=1):
    return [(source, i, f"e{i}", t, "Acme", "Berlin", None, None, f"http://x/{i}", None, None, None) for i, t in enumerate(titles)]


def cycle(spark, listings, state, complete=True, rebaseline=False, ratio=0.5):
    snap = T.with_keys(spark.createDataFrame(listings, LISTING))
    changes = D.diff(D.first_wins(snap), state)
    sources = spark.createDataFrame([(1, complete, rebaseline)], "source_id long, complete boolean, rebaseline boolean")
    verdict = D.guard(changes, snap.groupBy("source_id").agg(F.count(F.lit(1)).alias("size")), sources, ratio)
    flags = D.flagged(changes, verdict)
    return D.roll_forward(flags, now()), D.change_events(flags, now(), "c"), verdict


def test_cycles(spark):
    none = spark.createDataFrame([], D.STATE)
    six = [f"Engineer Level {i}" for i in "abcdef"]
    state, events, _ = cycle(spark, board([*six, "Engineer Level a (m/w/d)"]), none)
    state = spark.createDataFrame(state.collect(), D.STATE)
    assert state.count() == 6 and [r.type for r in events.collect()] == ["posting_opened"] * 6
    again, events, _ = cycle(spark, board(six), state)
    assert events.count() == 0 and again.where("state = 'open'").count() == 6
    refused, events, v = cycle(spark, board(six[:2]), state)
    assert not v.first().accepted and events.count() == 0 and sorted(refused.collect()) == sorted(state.collect())
    part, _, v = cycle(spark, board(six[:2]), state, complete=False)
    assert v.first().accepted and part.where("state = 'closed'").count() == 0
    closed, events, _ = cycle(spark, board(six[:5]), state)
    assert [r.type for r in events.collect()] == ["posting_closed"] and closed.where("state = 'closed'").count() == 1
    back, events, _ = cycle(spark, board(six), spark.createDataFrame(closed.collect(), D.STATE))
    assert [r.type for r in events.collect()] == ["posting_reposted"] and back.agg(F.sum("repost_count")).first()[0] == 1


def test_actions_and_sweeps(spark):
    state = spark.createDataFrame(cycle(spark, board(["A", "B"]), spark.createDataFrame([], D.STATE))[0].collect(), D.STATE)
    k = state.select("key").first().key
    at = lambda d: dt.datetime(2026, 7, d)
    log = [(1, k, at(1), "claim", "u"), (1, k, at(2), "applied", "u"), (1, k, at(3), "undo", "u")]
    out = D.apply_actions(state, spark.createDataFrame(log, "source_id long, key string, ts timestamp, action string, user string"))
    row = out.where(F.col("key") == k).first()
    assert row.claimed_by == "u" and row.applied_at is None
    assert [r.days for r in D.stale_sweep(out, now(), 14).collect()] == [29]
    log.append((1, k, at(4), "release", "u"))
    out = D.apply_actions(state, spark.createDataFrame(log, "source_id long, key string, ts timestamp, action string, user string"))
    assert out.where("claimed_by is not null").count() == 0


def test_filters(spark):
    src = spark.createDataFrame([(1, "gh", "acme"), (2, "gh", "x")], "source_id long, kind string, ident string")
    cfg = {"default": {"titleAny": ["|intern|", "Werkstudent"]}, "perSource": {"gh:acme": {"titleAny": [], "remote": "exclude"}}}
    specs = FL.compiled(FL.resolve(src, FL.spec_frame(spark, cfg)))
    rows = board(["International Lead", "Data Intern", "Werkstudent:in"], 2) + [(1, 9, "e", "Any", "A", None, True, None, "u", None, None, None), (1, 10, "e", "Any", "A", None, None, None, "u", None, None, None)]
    got = {(r.source_id, r.pos): r.matches for r in FL.matching(spark.createDataFrame(rows, LISTING), specs, now()).collect()}
    assert got == {(2, 0): False, (2, 1): True, (2, 2): True, (1, 9): False, (1, 10): True}
    same = {"default": {"titleAny": ["werkstudent", "|INTERN|", "Werkstudent!"]}}
    other = FL.compiled(FL.resolve(src, FL.spec_frame(spark, same)))
    one = lambda s: FL.fingerprint(s).where("source_id = 2").first().filter_hash
    assert one(specs) == one(other)
    for bad in ({"default": {"remote": "maybe"}}, {"default": {"titleAny": "x"}}, {"default": {"maxAgeDays": 0}}, {"perSource": {"gh": {}}}, {"default": {"oops": 1}}):
        with pytest.raises(ValueError):
            FL.validate(bad)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier", "nation", "events", "pages", "documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, oracle, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = oracle.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted(str([str(r[i]) for i in at]) for r in cur.fetchall())
    assert sorted(str([str(r[c]) for c in cols]) for r in df.collect()) == want


def test_cycle_by_status(spark):
    """Sources by what their fetch said: only good ones are diffed, a new filter hash re-baselines once, a refused source counts a failure."""
    from tidemark.operators import cycle as C

    at = now()
    titles = [f"Job {c}" for c in "abcdef"]
    state = None
    for source in range(1, 7):
        rows = spark.createDataFrame(board(titles, source), LISTING)
        seeded = D.roll_forward(D.diff(D.first_wins(rows), spark.createDataFrame([], D.STATE)).withColumns({"accepted": F.lit(True), "may_close": F.lit(False)}), at)
        state = seeded if state is None else state.unionByName(seeded)
    state = spark.createDataFrame(state.collect(), D.STATE)
    src = spark.createDataFrame([(i, "k", str(i)) for i in range(1, 7)], "source_id long, kind string, ident string")
    specs = FL.fingerprint(FL.compiled(FL.resolve(src, FL.spec_frame(spark, {"default": {"titleNone": ["Job b"]}}))))
    h = specs.first().filter_hash
    sources = spark.createDataFrame([(1, True, 2, "e", None, h), (2, True, 0, None, None, h), (3, True, 5, None, None, h), (4, True, 1, None, None, h), (5, True, 0, None, None, None), (6, False, 0, None, None, h)], "source_id long, complete boolean, fail_count int, etag string, last_poll timestamp, filter_hash string")
    statuses = spark.createDataFrame([(1, "ok", "f"), (2, "not_modified", "g"), (3, "ok", None), (5, "ok", None), (6, "ok", None)], "source_id long, status string, etag string")
    # 1 lacks all but one of its five watched jobs, 5 two of them, 6 three, 3 is muted and 4 said nothing
    fetched = board(titles[:2], 1) + board(titles, 3) + board(titles[:4], 5) + board(titles[:3], 6)
    run = C.run_cycle(sources, statuses, spark.createDataFrame(fetched, LISTING), specs, state, at, "c")
    got = {r.source_id: r for r in run.sources.collect()}
    assert {i: r.fail_count for i, r in got.items()} == {1: 3, 2: 0, 3: 5, 4: 2, 5: 0, 6: 0}
    assert got[1].etag == "e" and got[2].etag == "g" and got[1].last_poll is None and got[2].last_poll is not None and got[5].filter_hash == h
    report = {r.source_id: r for r in run.report.collect()}
    assert report[1].error.startswith("refused") and report[1].skipped and report[4].error == "failed" and report[3].skipped and report[2].not_modified and report[5].rebaselined
    assert report[5].filtered == 1 and report[5].closed == 0 and report[6].closed == 0
    assert run.events.count() == 0 and run.state.where("state = 'open'").count() == 36
    after = spark.createDataFrame(run.state.collect(), D.STATE)
    again = C.run_cycle(spark.createDataFrame(run.sources.collect(), sources.schema), statuses, spark.createDataFrame(fetched, LISTING), specs, after, at, "d")
    assert {r.type for r in again.events.where("source_id = 5").collect()} == {"posting_closed"} and {r.source_id: r.closed for r in again.report.collect()}[5] == 3


def test_nudges_come_once(spark):
    from tidemark.operators import cycle as C

    rows = spark.createDataFrame(cycle(spark, board(["A", "B"]), spark.createDataFrame([], D.STATE))[0].collect(), D.STATE)
    claimed = rows.withColumns({"claimed_by": F.lit("u"), "claimed_at": now() - F.make_interval(days=F.lit(20)), "closes_at": now() + F.make_interval(days=F.lit(2))})
    once, first = C.nudges(claimed, now(), "c")
    assert sorted((r.type, r.payload) for r in first.collect()) == sorted([("stale", '{"days":14}'), ("deadline", '{"closesAt":"2026-08-01T00:00:00Z","days":3}')] * 2)
    assert C.nudges(once, now(), "d")[1].count() == 0
