"""Postings as keyed streaming state.

The operator is ``transformWithState``: a map state holds the rows of a shard of a source, by key, and event-time timers nudge. Shards keep a
large source from landing in one task. Whether a snapshot may be applied depends on its whole source, so a cycle takes two steps: every shard holds the
snapshot's rows in a second map, and says how many open rows it has and how many would vanish; the sink adds these up, and its verdict comes back to the
shards as another row of the stream. Then each shard applies or drops what it holds. Cycles of a source, and user actions between them, are worked
off in the order of their times, whatever batch brings them; a nudge that is due between two of them is told between them.

State and events are those of ``cycle.run_cycle``, and nudges those of ``cycle.nudges`` run once a day at midnight. Rows that change go to ``folder/rows``, events to ``folder/events``, by
batch: a batch run again after a failure writes the same files again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import diff as D

DAY = 86_400_000_000
#: State columns; instants are microseconds.
TYPES = {n: "bigint" if t == "timestamp" else t for n, t in (c.strip().split() for c in D.STATE.split(",")) if n not in ("source_id", "key")}
ROW = ", ".join(f"{n} {t}" for n, t in TYPES.items())
FIELDS = ("external_id", "title", "company", "location", "remote", "department", "url", "posted_at", "closes_at", "description")
LISTING = "pos bigint, " + ", ".join(f"{n} {TYPES[n]}" for n in FIELDS)
#: What comes in. kind: row (a listing of a snapshot), end (the snapshot is whole; size rows), verdict, action. ``at`` is the stream's clock, ``time`` the cycle's or action's instant.
FEED = f"at timestamp, kind string, source_id bigint, shard int, cycle bigint, time bigint, key string, listing struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in LISTING.split(', '))}>, complete boolean, rebaseline boolean, size bigint, accepted boolean, action string, user string"
#: What goes out. kind: tally, event, row (JSON in ``payload``), clock (the latest instant that a shard has met).
OUT = "kind string, source_id bigint, shard int, cycle bigint, time bigint, key string, type string, payload string, complete boolean, rebaseline boolean, size bigint, open_before bigint, vanished bigint, clock bigint"


def _json(**fields) -> str:
    return json.dumps({k: v for k, v in fields.items() if v is not None}, separators=(",", ":"), ensure_ascii=False)


def _days(start: int | None, end: int) -> int:
    """Whole days, half up, never negative; 0 if unknown."""
    return 0 if start is None else max(0, (2 * (end - start) + DAY) // (2 * DAY))


class Postings(StatefulProcessor):
    """One shard of a source. ``todo`` (JSON) holds ends without a verdict, actions behind them, the clock, and the day up to which nudges were told."""

    def __init__(self, stale_days: int, deadline_days: int):
        self.stale, self.deadline = stale_days, deadline_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "key string", ROW)
        self.held = handle.getMapState("held", "cycle bigint, key string", LISTING)
        self.due = handle.getMapState("due", "day bigint", "keys array<string>")
        self.todo = handle.getValueState("todo", "text string")

    def close(self) -> None:
        pass

    # ---- in and out ----
    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        todo = self._load()
        for r in rows:
            todo["clock"] = max(todo["clock"], int(r["at"].timestamp() * 1_000_000))
            if r["kind"] == "row":
                name, new = (r["cycle"], r["key"]), r["listing"]
                if not self.held.containsKey(name) or new["pos"] < self.held.getValue(name)[0]:
                    self.held.updateValue(name, tuple(new[c] for c in ("pos", *FIELDS)))
            elif r["kind"] == "end":
                todo["ends"].setdefault(str(r["cycle"]), {"time": r["time"], "complete": r["complete"], "rebaseline": r["rebaseline"], "size": r["size"]})
            elif r["kind"] == "verdict":
                if str(r["cycle"]) in todo["ends"]:
                    todo["ends"][str(r["cycle"])]["accepted"] = r["accepted"]
            else:
                todo["actions"].append([r["time"], r["key"], r["action"], r["user"]])
        yield from self._drain(key, todo)
        yield _out(key, "clock", clock=todo["clock"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        todo = self._load()
        first = self._first(todo)
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        yield from self._tell(key, todo, upto if first is None else min(upto, first[0]))
        self._save(todo)

    def _load(self) -> dict:
        return json.loads(self.todo.get()[0]) if self.todo.exists() else {"ends": {}, "actions": [], "clock": 0, "told": -1}

    def _save(self, todo: dict) -> None:
        self.todo.update((json.dumps(todo),))
        days = [d[0] for d in self.due.keys()]
        if days:
            self.handle.registerTimer(min(days) // 1000)

    # ---- the order of things ----
    def _first(self, todo: dict) -> tuple | None:
        ends = min(((e["time"], 0, c) for c, e in todo["ends"].items()), default=None)
        actions = min(((a[0], 1, i) for i, a in enumerate(todo["actions"])), default=None)
        return min((x for x in (ends, actions) if x is not None), default=None)

    def _drain(self, key, todo: dict) -> Iterator[Row]:
        while (first := self._first(todo)) is not None:
            time, is_action, which = first
            if is_action:
                yield from self._tell(key, todo, time)
                yield from self._act(key, *todo["actions"].pop(which), todo)
                continue
            end = todo["ends"][which]
            if "accepted" not in end:
                if not end.get("told"):
                    end["told"] = True
                    yield self._tally(key, int(which), end, todo)
                break
            yield from self._tell(key, todo, time)
            if end["accepted"]:
                yield from self._apply(key, int(which), end, todo)
            for name in [n for n in self.held.keys() if n[0] == int(which)]:
                self.held.removeKey(tuple(name))
            del todo["ends"][which]
        self._save(todo)

    def _tally(self, key, cycle: int, end: dict, todo: dict) -> Row:
        opened = vanished = 0
        at = list(TYPES).index("state")
        for (k,), row in self.rows.iterator():
            if row[at] == "open":
                opened += 1
                vanished += not self.held.containsKey((cycle, k))
        return _out(key, "tally", cycle=cycle, time=end["time"], complete=end["complete"], rebaseline=end["rebaseline"], size=end["size"], open_before=opened, vanished=vanished, clock=todo["clock"])

    # ---- changes ----
    def _put(self, key, k: str, row: dict, now: int, todo: dict) -> Row:
        self.rows.updateValue((k,), tuple(row[c] for c in TYPES))
        days = []
        if row["state"] == "open" and row["applied_at"] is None:
            soonest = max(now, todo["told"]) // DAY + 1
            if row["claimed_by"] is not None and row["claimed_at"] is not None and row["stale_notified_at"] is None:
                days.append(max(soonest, (row["claimed_at"] + self.stale * DAY) // DAY + 1))
            if row["closes_at"] is not None and row["deadline_notified_at"] is None:
                day = max(soonest, -(-(row["closes_at"] - self.deadline * DAY) // DAY))
                if day * DAY < row["closes_at"]:
                    days.append(day)
        for day in set(days):
            name = (day * DAY,)
            keys = list(self.due.getValue(name)[0]) if self.due.containsKey(name) else []
            if k not in keys:
                self.due.updateValue(name, ([*keys, k],))
        return _out(key, "row", time=now, key=k, payload=json.dumps(row))

    def _apply(self, key, cycle: int, end: dict, todo: dict) -> Iterator[Row]:
        now, may_close = end["time"], end["complete"] and not end["rebaseline"]
        event = lambda k, kind, payload: _out(key, "event", cycle=cycle, time=now, key=k, type=kind, payload=payload)
        stored = {k: dict(zip(TYPES, row, strict=True)) for (k,), row in self.rows.iterator()}
        for (c, k), values in list(self.held.iterator()):
            if c != cycle:
                continue
            f = dict(zip(("pos", *FIELDS), values, strict=True))
            s = stored.pop(k, None)
            row = dict.fromkeys(TYPES) if s is None else dict(s)
            row |= {c: f[c] for c in D.REFRESHED} | {"last_seen": now, "state": "open", "closed_at": None}
            if f["description"] is not None:
                row["description"] = f["description"]
            if s is None:
                row |= {"company": f["company"], "posted_at": now if f["posted_at"] is None else f["posted_at"], "posted_at_exact": f["posted_at"] is not None, "first_seen": now, "repost_count": 0}
                yield event(k, "posting_opened", "{}")
            elif s["state"] == "closed":
                row |= {"posted_at": s["posted_at"] if f["posted_at"] is None else f["posted_at"], "posted_at_exact": f["posted_at"] is not None, "repost_count": s["repost_count"] + 1, "stale_notified_at": None, "deadline_notified_at": None}
                yield event(k, "posting_reposted", _json(gapDays=_days(s["closed_at"], now), previousExternalId=s["external_id"]))
            elif fields := [c for c in D.NEWSWORTHY if s[c] != f[c]]:
                yield event(k, "posting_opened", _json(update=True, fields=fields))
            yield self._put(key, k, row, now, todo)
        for k, s in stored.items():
            if s["state"] == "open" and may_close:
                if s["claimed_by"] is not None and s["applied_at"] is None:
                    yield event(k, "vanished_while_claimed", _json(claimedBy=s["claimed_by"], daysHeld=_days(s["claimed_at"], now)))
                else:
                    yield event(k, "posting_closed", _json(applied=s["applied_at"] is not None))
                yield self._put(key, k, s | {"state": "closed", "closed_at": now}, now, todo)

    def _act(self, key, time: int, k: str, action: str, user: str | None, todo: dict) -> Iterator[Row]:
        if self.rows.containsKey((k,)):
            row = dict(zip(TYPES, self.rows.getValue((k,)), strict=True))
            if action in ("claim", "release"):
                row |= {"claimed_by": user, "claimed_at": time} if action == "claim" else {"claimed_by": None, "claimed_at": None}
            elif action in ("applied", "undo"):
                row["applied_at"] = time if action == "applied" else None
            yield self._put(key, k, row, time, todo)

    def _tell(self, key, todo: dict, upto: int) -> Iterator[Row]:
        """Nudges of all days up to ``upto``; what was released, applied to, closed or told meanwhile says nothing."""
        for day in sorted(d[0] for d in list(self.due.keys()) if d[0] <= upto):
            keys = list(self.due.getValue((day,))[0])
            self.due.removeKey((day,))
            todo["told"] = max(todo["told"], day)
            for k in keys:
                row = dict(zip(TYPES, self.rows.getValue((k,)), strict=True))
                if row["state"] != "open" or row["applied_at"] is not None:
                    continue
                told = dict(row)
                if row["claimed_by"] is not None and row["stale_notified_at"] is None and row["claimed_at"] is not None and row["claimed_at"] < day - self.stale * DAY:
                    told["stale_notified_at"] = day
                    yield _out(key, "event", time=day, key=k, type="stale", payload=_json(days=self.stale))
                closes = row["closes_at"]
                if closes is not None and row["deadline_notified_at"] is None and day < closes <= day + self.deadline * DAY:
                    told["deadline_notified_at"] = day
                    yield _out(key, "event", time=day, key=k, type="deadline", payload=_json(closesAt=_iso(closes), days=self.deadline))
                if told != row:
                    yield self._put(key, k, told, day, todo)


def _iso(micros: int) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(micros // 1_000_000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _out(of, kind: str, **fields) -> Row:
    names = [c.strip().split()[0] for c in OUT.split(",")]
    return Row(**{n: None for n in names} | {"kind": kind, "source_id": of[0], "shard": of[1]} | fields)


def shard_of(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def fed(shards: int, snapshots: DataFrame | None = None, ends: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """``FEED`` rows. ``snapshots``: keyed, filtered listings with ``cycle`` and ``as_of``; ``ends``: (cycle, as_of, source_id, complete, rebaseline, size); ``actions``: (source_id, key, ts, action, user)."""
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    parts = []
    if snapshots is not None:
        listing = F.struct(*[F.unix_micros(c).alias(c) if c in ("posted_at", "closes_at") else F.col(c) for c in ("pos", *FIELDS)]).alias("listing")
        parts.append(snapshots.select(F.col("as_of").alias("at"), F.lit("row").alias("kind"), "source_id", shard_of(shards).alias("shard"), "cycle", F.unix_micros("as_of").alias("time"), "key", listing))
    if ends is not None:
        parts.append(ends.select(F.col("as_of").alias("at"), F.lit("end").alias("kind"), "source_id", every, "cycle", F.unix_micros("as_of").alias("time"), "complete", "rebaseline", "size"))
    if actions is not None:
        parts.append(actions.select(F.col("ts").alias("at"), F.lit("action").alias("kind"), "source_id", shard_of(shards).alias("shard"), F.unix_micros("ts").alias("time"), "key", "action", "user"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    none = [F.lit(None).cast(t).alias(n) for n, t in ((f.name, f.dataType) for f in out.sparkSession.createDataFrame([], FEED).schema) if n not in out.columns]
    return out.select("*", *none).select(*[f.name for f in out.sparkSession.createDataFrame([], FEED).schema])


def start(feed: DataFrame, folder: str, checkpoint: str, shards: int, ratio: float = 0.5, stale_days: int = 14, deadline_days: int = 3, lateness: str = "1 hour"):
    """Start the query over a stream of ``FEED`` rows; its verdicts come back by way of ``folder/verdicts``."""
    spark = feed.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    verdicts = f"{folder}/verdicts"
    spark.createDataFrame([], FEED).write.mode("append").parquet(verdicts)
    every = feed.unionByName(spark.readStream.schema(FEED).parquet(verdicts)).withWatermark("at", lateness)
    out = every.groupBy("source_id", "shard").transformWithState(Postings(stale_days, deadline_days), OUT, "Append", "EventTime")

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            rows.where("kind = 'row'").select("source_id", "key", "time", "payload").write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
            events = rows.where("kind = 'event'").select("source_id", "key", "type", "payload", F.timestamp_micros("time").alias("created_at"), F.coalesce(F.col("cycle").cast("string"), F.concat(F.lit("t"), F.col("time").cast("string"))).alias("cycle"))
            ided = events.withColumn("event_id", F.sha2(F.concat_ws("|", "cycle", "source_id", "key", "type"), 256)).drop("cycle")
            ided.write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
            tallies = rows.where("kind = 'tally'")
            tallies.write.mode("overwrite").parquet(f"{folder}/tallies/batch={number}")
            if not tallies.isEmpty():
                # not before anything this batch has met: rows behind the watermark would be dropped as late
                _decide(spark, folder, shards, ratio, rows.agg(F.max("clock").alias("c")).first()["c"])
        finally:
            rows.unpersist()

    return out.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").start()


def _decide(spark: SparkSession, folder: str, shards: int, ratio: float, clock: int) -> None:
    """Verdicts on the cycles of which every shard has told its numbers."""
    known = spark.read.schema(FEED).parquet(f"{folder}/verdicts").select("source_id", "cycle").distinct()
    told = spark.read.parquet(f"{folder}/tallies").dropDuplicates(["source_id", "cycle", "shard"]).join(known, ["source_id", "cycle"], "left_anti")
    sums = told.groupBy("source_id", "cycle").agg(*[F.max(c).alias(c) for c in ("time", "complete", "rebaseline", "size", "clock")], F.sum("open_before").alias("open_before"), F.sum("vanished").alias("vanished"), F.count(F.lit(1)).alias("n"))
    done = sums.where(F.col("n") == shards).withColumn("accepted", D.accepts(ratio))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    rows = done.select(F.timestamp_micros(F.greatest(F.col("clock"), F.lit(clock)) + 1000).alias("at"), F.lit("verdict").alias("kind"), "source_id", every, "cycle", "time", "accepted")
    empty = spark.createDataFrame([], FEED)
    empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns).write.mode("append").parquet(f"{folder}/verdicts")


def rows_of(spark: SparkSession, folder: str) -> DataFrame:
    """The state as ``diff.STATE``, from the last change of each posting."""
    changes = spark.read.parquet(f"{folder}/rows")
    last = changes.groupBy("source_id", "key").agg(F.max_by("payload", F.struct("time", "batch")).alias("p"))
    r = last.select("source_id", "key", F.from_json("p", ROW).alias("r"))
    times = [n for n, t in (c.strip().split() for c in D.STATE.split(",")) if t == "timestamp"]
    return r.select("source_id", "key", *[(F.timestamp_micros(F.col(f"r.{c}")) if c in times else F.col(f"r.{c}")).alias(c) for c in TYPES])
