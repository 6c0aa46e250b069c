import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import with_keys
from tidemark.operators import cycle as C
from tidemark.operators import diff as D
from tidemark.operators import filters as FL
from tidemark.streaming import cycles
from tidemark.streaming.store import PAGES, Store

LISTING = "source_id long, pos long, external_id string, title string, company string, location string, remote boolean, department string, url string, posted_at timestamp, closes_at timestamp, description string"
SEEDED = "source_id long, kind string, ident string, complete boolean"
CONFIG = {"default": {"titleNone": ["blocked"]}}


def specs_of(config=CONFIG):
    return lambda sources: FL.fingerprint(FL.compiled(FL.resolve(sources, FL.spec_frame(sources.sparkSession, config))))


def listing(source, n, title=None, url="http://x", text=None):
    return (source, n, f"e{n}", title or f"Warden Grade {chr(97 + n)}", "Acme", "Berlin", None, None, url, None, None, text)


def store_of(spark, path, sources, **options):
    store = Store(spark, str(path), **options)
    cycles.seed(store, spark.createDataFrame([(i, "lever", f"b{i}", complete) for i, complete in sources], SEEDED))
    return store


KEYS = {}


def keyed(spark, rows):
    """Listings with their keys; a title's is computed once."""
    fresh = [r for r in rows if r[3] not in KEYS]
    if fresh:
        KEYS.update({r.title: (r.key, r.key_full) for r in with_keys(spark.createDataFrame(fresh, LISTING)).collect()})
    return spark.createDataFrame([(*r, *KEYS[r[3]]) for r in rows], LISTING + ", key string, key_full string")


def step(store, cycle, rows, statuses, nudge=None):
    said = store.spark.createDataFrame([(i, s, None) for i, s in statuses.items()], "source_id long, status string, etag string")
    return cycles.apply_cycle(store, cycle, f"2026-07-{cycle:02d} 12:00:00", said, keyed(store.spark, rows), specs_of(), nudge=nudge)


def files(store, name):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{store.folder}/{name}") for f in fs if f.endswith(".parquet")}


def rows_of(df, *less):
    cols = [c for c in df.columns if c not in less]
    return sorted(map(str, df.select(*cols).collect()))


def test_stream_equals_batch_cycles(spark, tmp_path):
    """Cycles 6 to 11 with random boards and statuses: state, events and source table are those of ``run_cycle`` over whole tables."""
    r = random.Random(5)
    store = store_of(spark, tmp_path, [(1, True), (2, True), (3, False)], buckets=4, most_deltas=3)
    state = spark.createDataFrame([], D.STATE)
    sources = store.sources(store.manifest())
    sources = spark.createDataFrame(sources.collect(), sources.schema)
    told, specs = [], spark.createDataFrame((made := specs_of()(sources)).collect(), made.schema)
    board = {s: {n: f"text {n}" if n % 2 else None for n in range(8)} for s in (1, 2, 3)}
    for cycle in range(6, 12):
        statuses = {s: r.choice(["ok", "ok", "ok", "not_modified", "failed"]) for s in (1, 2, 3)}
        for s in (1, 2, 3):
            for n in r.sample(range(10), 2):
                if n in board[s]:
                    del board[s][n]
                else:
                    board[s][n] = r.choice([None, f"text {cycle}"])
        if cycle in (6, 10):
            statuses = dict.fromkeys(statuses, "ok")
        rows = [listing(s, n, url=f"http://{n % 3 and cycle // 9}", text=t) for s in board for n, t in board[s].items()] + [listing(1, 20, "Blocked Job")]
        assert step(store, cycle, rows, statuses)
        at = F.lit(f"2026-07-{cycle:02d} 12:00:00").cast("timestamp")
        said = spark.createDataFrame([(i, s, None) for i, s in statuses.items()], "source_id long, status string, etag string")
        run = C.run_cycle(sources, said, keyed(spark, rows), specs, state, at, str(cycle))
        told += run.events.collect()
        state, sources = spark.createDataFrame(run.state.collect(), D.STATE), spark.createDataFrame(run.sources.collect(), sources.schema)
    m = store.manifest()
    assert rows_of(store.described(m)) == rows_of(state)
    assert sorted(map(str, store.events().collect())) == sorted(map(str, told)) and {e.type for e in told} >= {"posting_opened", "posting_closed", "posting_reposted"}
    assert rows_of(store.sources(m), "seen_at") == rows_of(sources, "seen_at")
    assert max(len(e["deltas"]) for e in m["state"].values()) <= 4 and any(e["base"] for e in m["state"].values())
    assert not step(store, 11, [], {1: "ok"})
    store.compact(force=True)
    assert rows_of(store.described(store.manifest())) == rows_of(state) and store.manifest()["cycle"] == 11


def test_cycle_ten_follows_nine(spark, tmp_path):
    store = store_of(spark, tmp_path, [(1, True)])
    rows = [listing(1, n) for n in range(6)]
    for cycle in (9, 10):
        step(store, cycle, rows, {1: "ok"})
    assert not step(store, 2, rows[:1], {1: "ok"})
    assert store.events().groupBy("type").count().collect() == [("posting_opened", 6)]
    state = store.state(store.manifest()).select(F.date_format("first_seen", "d").alias("f"), F.date_format("last_seen", "d").alias("l")).distinct().collect()
    assert state == [("9", "10")]


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    store = store_of(spark, tmp_path, [(i, True) for i in range(8)], buckets=8)
    rows = [listing(i, n, text="long text " * 50) for i in range(8) for n in range(12)]
    step(store, 1, rows, dict.fromkeys(range(8), "ok"))
    first = files(store, "state") | files(store, "texts")
    size = sum(map(os.path.getsize, first))
    m = store.manifest()
    live = spark.createDataFrame([(3,)], "source_id long")
    (b,) = store.buckets_of(live)
    read = store.keyed("state", m, [b]).inputFiles()
    assert read and all(f"bucket={b}/" in f for f in read)
    changed = [r if r[1] else (*r[:8], "http://moved", *r[9:]) for r in rows if r[0] == 3]
    step(store, 2, changed, {3: "ok"} | {i: "not_modified" for i in range(8) if i != 3})
    fresh = (files(store, "state") | files(store, "texts")) - first
    assert first <= files(store, "state") | files(store, "texts") and all(f"bucket={b}/" in f for f in fresh)
    assert spark.read.parquet(*fresh).count() == 1 and sum(map(os.path.getsize, fresh)) < size / 4
    seen = {r.source_id: r.d for r in store.state(store.manifest()).select("source_id", F.date_format("last_seen", "d").alias("d")).distinct().collect()}
    assert seen == {i: "2" if i == 3 else "1" for i in range(8)}
    step(store, 3, changed, {3: "ok"})
    assert files(store, "state") | files(store, "texts") == first | fresh  # nothing changed, nothing written


def test_texts_stay_out_of_the_diff(spark, tmp_path):
    store = store_of(spark, tmp_path, [(1, True)])
    step(store, 1, [listing(1, 0, text="one"), listing(1, 1, text="two"), listing(1, 2)], {1: "ok"})
    step(store, 2, [listing(1, 0, text="one"), listing(1, 1, text="new"), listing(1, 2, text="late")], {1: "ok"})
    step(store, 3, [listing(1, 0), listing(1, 1, text="new"), listing(1, 2, text="late")], {1: "ok"})  # a missing text doesn't replace one
    m = store.manifest()
    assert {r.external_id: r.description for r in store.described(m).collect()} == {"e0": "one", "e1": "new", "e2": "late"}
    assert sorted(r.description for r in store.keyed("texts", m).collect()) == ["late", "new", "one"]
    assert sum(spark.read.parquet(f).count() for f in files(store, "texts")) == 4
    sources = store.sources(m)
    plan = C.planned(sources, spark.createDataFrame([(1, "ok", None)], "source_id long, status string, etag string"), specs_of()(sources))
    got = C.compared(plan, spark.createDataFrame([listing(1, 0)], LISTING).withColumn("text_hash", F.lit("h")).drop("description"), specs_of()(sources), store.state(m), F.lit("2026-07-04").cast("timestamp"))
    assert all("description" not in got.flags.schema[side].dataType.names and "text_hash" in got.flags.schema[side].dataType.names for side in ("s", "f"))


def test_a_kill_between_any_two_writes_changes_nothing_twice(spark, tmp_path, monkeypatch):
    store = store_of(spark, tmp_path, [(1, True), (2, True)])
    step(store, 1, [listing(s, n, text="t") for s in (1, 2) for n in range(6)], {1: "ok", 2: "ok"})
    rows = [listing(s, n, text="u") for s in (1, 2) for n in range(1, 7)]
    before, said = store.manifest(), rows_of(store.described(store.manifest()))

    class Killed(Exception):
        pass

    for k in range(5):
        left = [k]

        def dying(real, left=left):
            def call(*a, **b):
                if not left[0]:
                    raise Killed
                left[0] -= 1
                return real(*a, **b)

            return call

        with monkeypatch.context() as patch:
            for name in ("write", "write_keyed", "publish"):
                patch.setattr(store, name, dying(getattr(store, name)))
            with pytest.raises(Killed):
                step(store, 2, rows, {1: "ok", 2: "ok"})
        assert store.manifest() == before and rows_of(store.described(before)) == said
    assert step(store, 2, rows, {1: "ok", 2: "ok"})
    assert {(r.type, r["count"]) for r in store.events().groupBy("type").count().collect()} == {("posting_opened", 14), ("posting_closed", 2)}
    assert store.events().select("event_id").distinct().count() == 16
    other = Store(spark, store.folder)
    with pytest.raises(RuntimeError):
        other.publish(store.manifest())


def test_guard_mute_and_isolation(spark, tmp_path):
    """A refused or unmodified source keeps its rows, and a refused one counts its failures; a muted one is left alone; others go on."""
    store = Store(spark, str(tmp_path))
    cycles.seed(store, spark.createDataFrame([(i, "lever", f"b{i}", True, 5 if i == 4 else 0) for i in (1, 2, 3, 4)], SEEDED + ", fail_count int"))
    rows = [listing(s, n) for s in (1, 2, 3) for n in range(6)]
    step(store, 1, rows, {1: "ok", 2: "ok", 3: "ok"})
    for cycle in (2, 3):
        step(store, cycle, [listing(1, 0)] + [listing(3, n) for n in range(6 if cycle < 3 else 5)] + [listing(4, n) for n in range(3)], {1: "ok", 2: "not_modified", 3: "ok", 4: "ok"})
    m = store.manifest()
    got = {r.source_id: (r.fail_count, r.last_poll and r.last_poll.day, r.seen_at and r.seen_at.day) for r in store.sources(m).collect()}
    assert got == {1: (2, 1, 1), 2: (0, 3, 1), 3: (0, 3, 3), 4: (5, None, None)}
    assert {r.source_id: r["count"] for r in store.state(m).where("state = 'open'").groupBy("source_id").count().collect()} == {1: 6, 2: 6, 3: 5}
    assert store.events().where("type = 'posting_closed'").count() == 1


def test_actions_and_nudges(spark, tmp_path):
    store = store_of(spark, tmp_path, [(1, True)])
    rows = [listing(1, n) for n in range(3)]
    step(store, 1, rows, {1: "ok"})
    keys = {r.external_id: r.key for r in store.state(store.manifest()).collect()}
    log = [(1, keys["e0"], "2026-07-01 13:00:00", "claim", "u"), (1, keys["e1"], "2026-07-01 13:00:00", "claim", "u")]
    cycles.act(store, spark.createDataFrame(log, "source_id long, key string, ts string, action string, user string").withColumn("ts", F.col("ts").cast("timestamp")))
    step(store, 15, rows, {1: "ok"}, (14, 3))
    assert store.events().where("type = 'stale'").count() == 0
    cycles.act(store, spark.createDataFrame([(1, keys["e1"], "2026-07-15 13:00:00", "release", "u")], "source_id long, key string, ts string, action string, user string").withColumn("ts", F.col("ts").cast("timestamp")))
    for cycle in (16, 17):
        step(store, cycle, rows, {1: "ok"}, (14, 3))
    assert [(r.key, r.created_at.day) for r in store.events().where("type = 'stale'").collect()] == [(keys["e0"], 16)]
    assert [r.external_id for r in store.state(store.manifest()).where("claimed_by is not null and stale_notified_at is not null").collect()] == ["e0"]


def landed(spark, folder, rows):
    spark.createDataFrame(rows, "cycle long, as_of string, source_id long, kind string, ident string, page_no int, status string, etag string, payload string").withColumn("as_of", F.col("as_of").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def test_pages_are_held_until_their_cycle_ends(spark, tmp_path):
    """Pages of a walk come in several batches; a walk that ends short closes nothing, and a batch run again holds nothing twice."""
    land, point = str(tmp_path / "in"), str(tmp_path / "point")
    store = Store(spark, str(tmp_path / "store"))
    cycles.seed(store, spark.createDataFrame([(1, "smartrecruiters", "acme", True), (2, "lever", "bolt", True)], SEEDED))
    at = lambda c: f"2026-07-{c:02d} 12:00:00"
    page = lambda c, n, ids, total: (c, at(c), 1, "smartrecruiters", "acme", n, None, None, json.dumps({"totalFound": total, "content": [{"id": f"p{i}", "name": f"Warden Grade {chr(97 + i)}"} for i in ids]}))
    lever = lambda c, n: (c, at(c), 2, "lever", "bolt", 0, None, None, json.dumps([{"id": f"l{i}", "text": f"Clerk {chr(97 + i)}", "hostedUrl": "u"} for i in range(n)]))
    end = lambda c: (c, at(c), None, None, None, None, None, None, None)

    def go():
        schema = PAGES
        cycles.run(spark.readStream.schema(schema).parquet(land), store, specs_of(), point, None).awaitTermination()

    landed(spark, land, [page(9, 0, range(4), 6), lever(9, 5)])
    go()
    assert store.manifest()["cycle"] is None and len(store.manifest()["pages"]) == 1
    landed(spark, land, [page(9, 1, range(4, 6), 6), end(9)])
    go()
    m = store.manifest()
    assert m["cycle"] == 9 and m["pages"] == [] and store.state(m).count() == 11
    landed(spark, land, [page(10, 0, range(3), 6), lever(10, 4), end(10)])  # the second page never came
    go()
    m = store.manifest()
    assert m["cycle"] == 10 and {r.source_id: r.n for r in store.state(m).where("state = 'open'").groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 6, 2: 4}
    assert {r.source_id: r.fail_count for r in store.sources(m).collect()} == {1: 1, 2: 0}
    said = m["number"]
    assert cycles.take(store, spark.read.schema(PAGES).parquet(land).where("cycle = 10"), specs_of(), batch=m["batch"]) == [] and store.manifest()["number"] == said
    assert store.events().groupBy("type").count().orderBy("type").collect() == [("posting_closed", 1), ("posting_opened", 11)]


def test_replay_equals_single_cycles(spark, tmp_path):
    rows = [(c, *listing(s, n)) for c in range(1, 4) for s in (1, 2) for n in range(8) if (n + c * s) % 5]
    listings = spark.createDataFrame(rows, "cycle long, " + LISTING).join(keyed(spark, [r[1:] for r in rows]).select("title", "key", "key_full").distinct(), "title")
    statuses = spark.createDataFrame([(c, s, "ok", None) for c in range(1, 4) for s in (1, 2)], "cycle long, source_id long, status string, etag string")
    at = [(c, f"2026-07-{c:02d} 12:00:00") for c in range(1, 4)]
    whole = store_of(spark, tmp_path / "a", [(1, True), (2, True)])
    assert cycles.replay(whole, reversed(at), statuses, listings, specs_of()) == [1, 2, 3]
    single = store_of(spark, tmp_path / "b", [(1, True), (2, True)])
    for c, _ in at:
        step(single, c, [r[1:] for r in rows if r[0] == c], {1: "ok", 2: "ok"})
    for get in (lambda s: s.state(s.manifest()), lambda s: s.events(), lambda s: s.sources(s.manifest())):
        assert rows_of(get(whole)) == rows_of(get(single))


def test_only_new_strings_are_normalised(spark, tmp_path):
    store = store_of(spark, tmp_path, [(1, True)])
    said = spark.createDataFrame([(1, "ok", None)], "source_id long, status string, etag string")
    go = lambda c, n: cycles.apply_cycle(store, c, f"2026-07-0{c} 12:00:00", said, spark.createDataFrame([listing(1, i) for i in range(n)], LISTING), specs_of(), nudge=None)
    go(1, 6)
    assert store.names(store.manifest()).count() == 8 and len(store.manifest()["names"]) == 1
    before = files(store, "names")
    go(2, 7)
    fresh = spark.read.parquet(f"{store.folder}/{store.manifest()['names'][1]}").collect()
    assert [r.raw for r in fresh] == ["Warden Grade g"] and before < files(store, "names")
    want = {r.key for r in keyed(spark, [listing(1, i) for i in range(7)]).collect()}
    assert {r.key for r in store.state(store.manifest()).collect()} == want


def test_delivery_repeats_at_most_one_batch(spark, tmp_path):
    from tidemark.streaming import delivery

    store = store_of(spark, tmp_path / "s", [(1, True)])
    step(store, 1, [listing(1, n) for n in range(7)], {1: "ok"})
    store.write("events", store.events(), 99)  # a commit that never was
    sent = []

    def send(batch):
        sent.append([r.event_id for r in batch.collect()])

    def dying(batch):
        send(batch)
        if len(sent) == 2:
            raise RuntimeError("killed")

    point = str(tmp_path / "point")
    with pytest.raises(Exception, match="killed"):
        delivery.start(store, dying, point, most=3).awaitTermination()
    assert [len(b) for b in sent] == [3, 3] and delivery.log(store).count() == 3
    delivery.start(store, send, point, most=3).awaitTermination()
    assert [len(b) for b in sent] == [3, 3, 3, 1] and sent[1] == sent[2]
    assert sorted({e for b in sent for e in b}) == sorted(r.event_id for r in store.events().collect()) and delivery.log(store).distinct().count() == 7
    step(store, 2, [listing(1, n) for n in range(6)], {1: "ok"})
    delivery.start(store, send, point, most=3).awaitTermination()
    assert len(sent) == 5 and len(sent[4]) == 1
