import random

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import cycle as C
from tidemark.operators import diff as D
from tidemark.operators import filters as FL
from tidemark.streaming import keyed as K

LISTING = "cycle long, as_of timestamp, source_id long, pos long, external_id string, title string, company string, location string, remote boolean, department string, url string, posted_at timestamp, closes_at timestamp, description string"
SHARDS = 2


def at(spark, rows, schema, *times):
    return spark.createDataFrame(rows, schema).withColumns({c: F.col(c).cast("timestamp") for c in times})


KEYS = {}


def listings(spark, rows):
    """Listings with their keys; a title's is computed once."""
    texts = LISTING.replace("timestamp", "string")
    fresh = [r for r in rows if r[5] not in KEYS]
    if fresh:
        KEYS.update({r.title: (r.key, r.key_full) for r in T.with_keys(spark.createDataFrame(fresh, texts)).collect()})
    return at(spark, [(*r, *KEYS[r[5]]) for r in rows], texts + ", key string, key_full string", "as_of", "posted_at", "closes_at")


def day(n, clock="12:00:00"):
    return f"2026-07-{n:02d} {clock}"


def test_keyed_state_equals_batch(spark, tmp_path):
    """Ten cycles of two sources, with actions between them: state and events are those of ``run_cycle``, nudges those of ``nudges`` run daily, also when the query is stopped and started again."""
    r = random.Random(11)
    board = {s: set(range(6)) for s in (1, 2)}
    closes = {(s, n): (day(6 + n) if n % 2 else None) for s in (1, 2) for n in range(8)}
    fetched = {}
    for c in range(1, 11):
        for s in (1, 2):
            for n in r.sample(range(8), 2):
                board[s] ^= {n}
        rows = [(c, day(c), s, n, f"e{n}", f"Warden Grade {chr(97 + n)}", "Acme", "Berlin", None, None, f"http://{c // 4}", None, closes[s, n], f"text {c}" if n == 3 else None) for s in (1, 2) for n in sorted(board[s])]
        if c == 5:
            rows = [x for x in rows if x[2] == 1] + [x for x in rows if x[2] == 2][:1]  # all but one of source 2 vanish
        fetched[c] = rows
    keys = {x.external_id: x.key for x in listings(spark, [(1, day(1), 1, n, f"e{n}", f"Warden Grade {chr(97 + n)}", "Acme", "Berlin", None, None, "u", None, None, None) for n in range(8)]).collect()}
    log = [(1, keys["e0"], day(1, "18:00:00"), "claim", "u"), (1, keys["e1"], day(1, "18:00:00"), "claim", "u"), (1, keys["e1"], day(3, "18:00:00"), "release", None), (2, keys["e2"], day(2, "18:00:00"), "claim", "v"), (2, keys["e2"], day(4, "18:00:00"), "applied", "v"), (2, keys["e4"], day(6, "18:00:00"), "claim", "v")]
    schema = "source_id long, key string, ts string, action string, user string"

    # the batch way: midnight nudges, noon cycles, evening actions
    state = spark.createDataFrame([], D.STATE)
    sources = at(spark, [(s, True, 0, None, None, None) for s in (1, 2)], "source_id long, complete boolean, fail_count int, etag string, last_poll string, filter_hash string", "last_poll")
    specs = FL.fingerprint(FL.compiled(FL.resolve(spark.createDataFrame([(s, "k", str(s)) for s in (1, 2)], "source_id long, kind string, ident string"), FL.spec_frame(spark, {"default": {}}))))
    specs = spark.createDataFrame(specs.collect(), specs.schema)
    sources = sources.withColumn("filter_hash", F.lit(specs.first().filter_hash))
    told = []
    for c in range(1, 11):
        state, nudges = C.nudges(state, F.lit(day(c, "00:00:00")).cast("timestamp"), "n", 4, 3)
        told += nudges.drop("event_id").collect()
        said = spark.createDataFrame([(s, "ok", None) for s in (1, 2)], "source_id long, status string, etag string")
        run = C.run_cycle(sources, said, listings(spark, fetched[c]).drop("cycle", "as_of"), specs, state, F.lit(day(c)).cast("timestamp"), str(c))
        told += run.events.drop("event_id").collect()
        mine = [x for x in log if x[2] == day(c, "18:00:00")]
        state = D.apply_actions(run.state, at(spark, mine, schema, "ts")) if mine else run.state
        state = spark.createDataFrame(state.collect(), D.STATE)

    # the keyed way: cycles 2 and 3, and 7 to 9, come in one file each, with the later first
    folder, point, land = str(tmp_path / "out"), str(tmp_path / "point"), str(tmp_path / "in")

    def arrive(cycles, actions=()):
        snap = listings(spark, [x for c in cycles for x in fetched[c]])
        ends = at(spark, [(c, day(c), s, True, False, sum(x[2] == s for x in fetched[c])) for c in cycles for s in (1, 2)], "cycle long, as_of string, source_id long, complete boolean, rebaseline boolean, size long", "as_of")
        mine = [x for x in log if x[2][8:10] in {f"{c:02d}" for c in actions}]
        K.fed(SHARDS, snap, ends, at(spark, mine, schema, "ts") if mine else None).coalesce(1).write.mode("append").parquet(land)

    arrive([1], [1])
    query = None
    for k, (cycles, actions) in enumerate([(None, None), ([3, 2], [2, 3]), ([4, 5], [4]), ([6], [6]), ([9, 8, 7], []), ([10], [])]):
        if cycles:
            arrive(cycles, actions)
        if query is None or k == 3:
            if query is not None:
                query.stop()
            query = K.start(spark.readStream.schema(K.FEED).parquet(land), folder, point, SHARDS, stale_days=4)
        query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(f"{folder}/events").drop("event_id", "batch")
    order = ["source_id", "key", "type", "payload", "created_at"]
    said = sorted(str(x) for x in got.select(*order).collect())
    want = sorted(str(x) for x in spark.createDataFrame(told).select(*order).collect())
    assert said == want and {x.type for x in told} >= {"stale", "deadline", "posting_opened", "posting_closed", "posting_reposted"}
    cols = D.state_columns()
    assert sorted(str(x) for x in K.rows_of(spark, folder).select(*cols).collect()) == sorted(str(x) for x in state.select(*cols).collect())


def test_timer_fires_without_new_rows_of_its_shard(spark, tmp_path):
    """The clock of other sources moves the watermark: a claimed posting goes stale though nothing of its own source arrives; a released one doesn't."""
    folder, land = str(tmp_path / "out"), str(tmp_path / "in")
    row = lambda c, s, n: (c, day(c), s, n, f"e{n}", f"Clerk {chr(97 + n)}", "Acme", "Berlin", None, None, "u", None, None, None)
    ends = lambda c, s, n: at(spark, [(c, day(c), s, True, False, n)], "cycle long, as_of string, source_id long, complete boolean, rebaseline boolean, size long", "as_of")
    first = listings(spark, [row(1, 1, 0), row(1, 1, 1)])
    keys = {x.external_id: x.key for x in first.collect()}
    acts = at(spark, [(1, keys["e0"], day(1, "18:00:00"), "claim", "u"), (1, keys["e1"], day(1, "18:00:00"), "claim", "u"), (1, keys["e1"], day(2, "18:00:00"), "release", None)], "source_id long, key string, ts string, action string, user string", "ts")
    K.fed(1, first, ends(1, 1, 2), acts).coalesce(1).write.parquet(land)
    query = K.start(spark.readStream.schema(K.FEED).parquet(land), folder, str(tmp_path / "point"), 1, stale_days=4)
    query.processAllAvailable()
    assert spark.read.parquet(f"{folder}/events").where("type = 'stale'").count() == 0
    for c in (20, 21):
        K.fed(1, listings(spark, [row(c, 2, 0)]), ends(c, 2, 1)).coalesce(1).write.mode("append").parquet(land)
        query.processAllAvailable()
    query.stop()
    stale = spark.read.parquet(f"{folder}/events").where("type = 'stale'").collect()
    assert [(x.source_id, x.key, x.created_at.day) for x in stale] == [(1, keys["e0"], 6)]
