"""Queries at work on all that the tables hold, and steps that must not grow faster than their input."""

import re

from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import text as T
from tidemark.operators import cycle as C
from tidemark.operators import diff as D
from tidemark.operators import names as N
from tidemark.plans import fixtures as X
from tidemark.plans import cycles, payloads
from tidemark.sources import feeds, merged


def test_violations_of_every_source(spark):
    """The extractor errs at all sources: none is left out of the strict check."""
    d = "/root/testdata/sf0.01"
    got = {(r.source_id, r.pos) for r in payloads.strict_violations(spark, d).where("reason = 'missing title'").collect()}
    ids = [r.page_id for r in spark.read.parquet(f"{d}/pages.parquet").where("page_id % 23 = 0 and page_id % 97 <> 0").select("page_id").collect()]
    assert got == {(i // 20, i % 20) for i in ids if i // 20 % 11 != 5}
    assert {s % 3 for s, _ in got} == {0, 1, 2}


def test_shared_strings_are_normalised_once(spark):
    """Many copies of few strings: the memo holds each once, and keys are those of the row-by-row form, whether the memo holds a string or not."""
    some = [("Dev (m/w/d)", "Acme GmbH", "Berlin, DE", False), ("Dev - Remote", "Acme, Inc.", None, True), ("Büro Ingénieur", "Süd AG", "Köln", None), (None, "Acme", "", True), ("Ops REQ-10004", None, "Remote", False)]
    rows = [(n * len(some) + i, *r) for n in range(40) for i, r in enumerate(some)] + [(1000, "Only one", "Solo Ltd", "Bonn", None)]
    listings = spark.createDataFrame(rows, "pos long, title string, company string, location string, remote boolean")
    want = {r.pos: (r.key_full, r.key) for r in T.with_keys(listings).collect()}
    for most in (1, 100_000):
        assert N.memo(listings, most).count() == min(most, 12)
        assert {r.pos: (r.key_full, r.key) for r in N.with_keys(listings, most).collect()} == want


def test_copies_of_a_key_go_before_wide_rows_are_moved(spark):
    """Of keys with many copies only the rows that may be first are sorted; what comes first stays the same, held or not."""
    rows = spark.range(3000).select((F.col("id") % 2).alias("source_id"), (F.col("id") % 5).cast("string").alias("key"), ((F.col("id") * 7919) % 3001).alias("pos"), F.col("id").alias("other"))
    late, even = F.col("pos") > 1000, F.col("other") % 2 == 0
    best = lambda df: sorted(map(tuple, D.first_wins(df).collect()))
    assert D.contenders(rows, late, even).count() <= 20
    for most in (3, 180_000):
        few = D.contenders(rows, late, even, most=most)
        assert best(few.where(late)) == best(rows.where(late)) and best(few.where(even)) == best(rows.where(even))


def test_wide_rows_are_read_at_first_places_only(spark):
    """However many keys there are, only rows at a first place of one are kept, also where rows of a source share a place; the first of each group stays the same."""
    rows = spark.range(3000).select((F.col("id") % 2).alias("source_id"), (F.col("id") % 5).cast("string").alias("key"), F.floor(F.col("id") * 7919 % 3001 / 10 * 5 + F.col("id") % 5).alias("pos"), F.col("id").alias("other"))
    rows = rows.dropDuplicates(["source_id", "key", "pos"]).withColumn("pos", F.floor(F.col("pos") / 5)).groupBy("source_id", "key", "pos").agg(F.min("other").alias("other"))
    late, even = F.col("pos") > 100, F.col("other") % 2 == 0
    best = lambda df: sorted(map(tuple, D.first_wins(df).select("source_id", "key", "pos", "other").collect()))
    places = D.first_places(rows, late, even, size=late)
    few = D.at_places(rows, places)
    assert few.count() < rows.count() / 10
    assert best(few.where(late)) == best(rows.where(late)) and best(few.where(even)) == best(rows.where(even))
    assert sum(r.size for r in places.select("size").collect()) == rows.where(late).count()


def test_listings_are_read_once_for_keys(spark):
    """A memo that wasn't cut holds the strings beyond ASCII, shared or not: no second branch reads the listings for their rows."""
    listings = spark.createDataFrame([(0, "Büro Ingénieur", "Süd AG", "Köln", None), (1, "Dev", "Acme, Inc.", None, True), (2, "Dev", "Acme GmbH", "Berlin, DE", False)], "pos long, title string, company string, location string, remote boolean")
    keyed = N.with_keys(listings)
    assert "Union" not in keyed._jdf.queryExecution().optimizedPlan().toString()
    same = lambda df: sorted((r.pos, r.key_full) for r in df.collect())
    assert same(keyed) == same(T.with_keys(listings)) == same(N.with_keys(listings, 2))


def test_both_feeds_are_parsed_once(spark):
    """Texts are made before the feeds are joined, so nothing is parsed for them again; positions without sections, or with blank ones, have none."""
    raw = lambda x: spark.createDataFrame([(1, "a", x)], "source_id long, ident string, payload string")
    job = lambda i, parts: f"<position><id>{i}</id><name>N</name>{parts}</position>"
    part = lambda h, b: f"<jobDescription><name>{h}</name><value><![CDATA[{b}]]></value></jobDescription>"
    some = f"<jobDescriptions>{part('A', '<b>x&#35;&amp;#33;</b>')}{part('', 'y')}{part('C', '<p> </p>')}</jobDescriptions>"
    none = f"<jobDescriptions>{part('D', ' ')}</jobDescriptions>"
    rows = merged.listings(raw('[{"id":"1","name":"J"},{"id":"9","name":"K"}]'), raw(f"<workzag-jobs>{job(1, some)}{job(2, none)}{job(3, '')}</workzag-jobs>"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert {r.external_id: r.description for r in rows.collect()} == {"1": "A\nx#!\n\ny", "9": None, "2": None, "3": None}


def test_pages_and_details_are_exchanged_as_bare_lines(spark):
    """Pages and details go through one exchange each, the joined listings through one more; no object or payload is made before the pages' exchange."""
    plan = payloads.paged_feed(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Exchange hashpartitioning") == 3
    page = [x for x in plan.optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x and "page_no" in x]
    before = plan.optimizedPlan().toString().split(page[0])[1].split("RepartitionByExpression")[0]
    assert len(page) == 1 and "concat_ws" not in before and "to_json" not in before and "named_struct" not in before


def test_copies_of_a_detail_page_count_once(spark):
    listings = feeds.paged(spark.createDataFrame([(1, 0, "acme", '{"content": [{"id": "9", "name": "N"}, {"id": "8", "name": "M"}]}')], "source_id long, page_no int, ident string, payload string"))
    page = '{"jobAd": {"sections": {"jobDescription": {"text": "<p>d</p>"}}}}'
    details = spark.createDataFrame([(1, "9", page), (1, "9", page)], "source_id long, external_id string, payload string")
    assert sorted((r.external_id, r.description) for r in feeds.with_details(listings, details).collect()) == [("8", None), ("9", "d")]


def test_first_rows_of_all_groups_come_from_one_aggregate(spark):
    """What ``first_wins`` finds group by group, with the counts, from one exchange of rows whose copies went before it."""
    rows = spark.range(3000).select((F.col("id") % 2).alias("source_id"), (F.col("id") % 5).cast("string").alias("key"), ((F.col("id") * 7919) % 3001).alias("pos"), F.col("id").alias("other"), F.lit("wide").alias("text"))
    late, even = F.col("pos") > 1000, (F.col("other") % 2 == 0) & (F.col("key") != "3")
    got = D.first_rows(rows, ("other",), {"l": late, "e": even}, size=late)
    plan = got._jdf.queryExecution().executedPlan().toString()
    for name, group in (("l", late), ("e", even)):
        want = {(r.source_id, r.key, r.pos, r.other) for r in D.first_wins(rows.where(group)).collect()}
        assert {(r.source_id, r.key, r[name].pos, r[name].other) for r in got.where(F.col(name).isNotNull()).collect()} == want
    assert sum(r["size"] for r in got.collect()) == rows.where(late).count()
    assert plan.count("Exchange") == 1 and "partial_min" in plan.split("Exchange")[1] and "wide" not in plan


def test_listings_are_read_once_for_both_sides_of_the_diff(spark):
    """Snapshot, state and counts come from one reading of lineitem, which the strings of the memo don't add to; no made-up text of a listing is exchanged."""
    d = "/root/testdata/sf0.001"
    spark.catalog.clearCache()
    rows = X.snapshot_and_state(spark, d)._jdf.queryExecution()
    assert rows.executedPlan().toString().count("FileScan parquet [l_orderkey") == 1
    assert not {"url", "title", "company", "external_id"} & {c.removeprefix("f_").removeprefix("s_") for c in X.snapshot_and_state(spark, d).columns}
    query = registry.queries()["snapshot_diff"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert query.count("FileScan parquet [l_orderkey") == 1 and "SortMergeJoin" not in query
    known = {r.tagged for r in X.known_strings(spark, d).select("tagged").collect()}
    texts = X.listings(spark, d).select(F.explode(F.array(*N._tagged().values())).alias("t")).where("t is not null").distinct()
    assert {r.t for r in texts.collect()} <= known


def test_names_of_many_suppliers_keep_the_memo_whole(spark, monkeypatch):
    """Where suppliers are many their plain names aren't held, and no second branch reads the listings; keys stay the same."""
    d = "/root/testdata/sf0.001"
    same = lambda df: sorted((r.source_id, r.pos, r.key_full) for r in df.select("source_id", "pos", "key_full").collect())
    spark.catalog.clearCache()
    want = same(X.keyed(spark, d))
    monkeypatch.setattr(X, "MOST_COMMON", 10)
    assert X.known_strings(spark, d).where("tagged like 'c%'").count() == 0
    keyed = X.keyed(spark, d)
    assert keyed._jdf.queryExecution().executedPlan().toString().count("FileScan parquet [l_orderkey") == 1 and same(keyed) == want


def test_changes_are_not_moved_to_their_sources(spark):
    """The verdict's size is known when flags are joined: changes stay where they are, and only partial sums of sources are exchanged."""
    spark.catalog.clearCache()
    plan = registry.queries()["cycle_totals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    flags = plan.split("InMemoryTableScan")[0]
    assert "partial_count_if" in flags or "partial_count" in flags
    assert "SortMergeJoin" not in flags and "BroadcastHashJoin" in flags


def test_cycles_keep_bare_rows_only(spark):
    """No wide listing is persisted for a cycle, and both sides of its diff come from one reading; its results are those of ``run_cycle`` over whole listings and state."""
    d = "/root/testdata/sf0.001"
    spark.catalog.clearCache()
    run = cycles._run(spark, d)
    for df in (run.events, run.state, run.report, run.sources):
        cached = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "InMemoryRelation [" in x]
        assert cached and not any(re.search(r"\b(title|url|company|external_id)#", x) for x in cached)
        assert df._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0].count("FileScan parquet [l_orderkey") == 0
    sources, statuses, specs = cycles._inputs(spark, d)
    want = C.run_cycle(sources, statuses, X.keyed(spark, d).where(X.in_snapshot()), specs, X.state(spark, d), X.as_of(), "c7")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(run.events) == rows(want.events) and rows(run.report) == rows(want.report) and rows(run.sources) == rows(want.sources)
    assert rows(run.state) == rows(want.state.select(*run.state.columns))
