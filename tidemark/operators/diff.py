"""Snapshot against state: identity, one full outer join, guard, roll-forward, events and reports.

Every function takes and returns DataFrames and an explicit ``as_of``. The diff is partitioned by (source_id, key), never by
source alone; per-source figures are partial aggregates joined back, one row a source, which Spark broadcasts while they are small.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import elapsed_days, elapsed_hours, with_keys

NEWSWORTHY = ("title", "location", "url", "closes_at")
#: Columns that a cycle refreshes on every present row; ``company`` is set on insertion only.
REFRESHED = ("external_id", "title", "location", "remote", "department", "url", "closes_at")
OURS = ("fit_score", "fit_reason", "fit_scored_at", "message_id", "claimed_by", "claimed_at", "applied_at")
MIN_BOARD = 4
ALERTS = ("posting_reposted", "vanished_while_claimed", "high_fit", "stale", "deadline")

STATE = (
    "source_id bigint, key string, external_id string, title string, company string, location string, remote boolean, department string, url string, "
    "posted_at timestamp, posted_at_exact boolean, closes_at timestamp, first_seen timestamp, last_seen timestamp, state string, closed_at timestamp, "
    "repost_count int, description string, fit_score int, fit_reason string, fit_scored_at timestamp, message_id string, claimed_by string, "
    "claimed_at timestamp, applied_at timestamp, stale_notified_at timestamp, deadline_notified_at timestamp"
)


def first_wins(listings: DataFrame) -> DataFrame:
    """The first listing (by ``pos``) of each (source_id, key). One exchange, shared with the diff's join."""
    keyed = listings if "key" in listings.columns else with_keys(listings)
    nth = F.row_number().over(Window.partitionBy("source_id", "key").orderBy("pos"))
    return keyed.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


#: Most keys whose first place is held while rows are read: so many are small enough to be broadcast.
MOST_HELD = 180_000


def contenders(keyed: DataFrame, *groups: Column, most: int = MOST_HELD) -> DataFrame:
    """Rows of the groups that may be the first of their key in one of them: of keys with many copies only those at the first place.

    The first places are found on bare keys, before any wide row is sorted or moved. Keys that aren't held keep all their rows, so ``first_wins`` of a group is the same over the contenders.
    """
    groups = groups or (F.lit(True),)
    some = reduce(or_, groups)
    least = [F.min(F.when(g, F.col("pos"))).alias(f"_least{n}") for n, g in enumerate(groups)]
    many = keyed.where(some).groupBy("source_id", "key").agg(*least, F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * len(groups)).drop("_n").limit(most)
    held = many.select(F.col("source_id").alias("_source"), F.col("key").alias("_key"), *[f"_least{n}" for n in range(len(groups))])
    j = keyed.where(some).join(held, (F.col("source_id") == F.col("_source")) & (F.col("key") == F.col("_key")), "left")
    first = reduce(or_, [F.coalesce(g & (F.col("pos") <= F.col(f"_least{n}")), F.lit(False)) for n, g in enumerate(groups)])
    return j.where(F.col("_key").isNull() | first).select(*keyed.columns)


def first_places(keyed: DataFrame, *groups: Column, **counts: Column) -> DataFrame:
    """(source_id, key, least, ..): by group the first place of each key, null if it has no row there; ``counts``: of how many rows of the key a condition holds. A hash aggregate over bare keys."""
    groups = groups or (F.lit(True),)
    least = [F.min(F.when(g, F.col("pos"))).alias(f"least{n}") for n, g in enumerate(groups)]
    return keyed.groupBy("source_id", "key").agg(F.array(*least).alias("least"), *[F.count_if(c).alias(name) for name, c in counts.items()])


def at_places(listings: DataFrame, places: DataFrame) -> DataFrame:
    """The listings, keyed or not, that lie at a first place. Others that share a source and a place come along; ``first_wins`` of a group drops them once they have keys."""
    wanted = places.select("source_id", F.explode("least").alias("pos")).where("pos is not null").distinct()
    return listings.join(wanted, ["source_id", "pos"], "left_semi")


def first_rows(keyed: DataFrame, columns: tuple[str, ...], groups: dict[str, Column], **counts: Column) -> DataFrame:
    """(source_id, key, counts, then each group as struct(pos, columns)): the first row of a key in each group, null if it has none there, and of how many of its rows a condition holds.

    One aggregate over one reading of rows as narrow as ``columns``: copies of a key go before the exchange, and what is left is moved once for all groups. Of rows at the same place the least comes first.
    """
    row = F.struct("pos", *columns)
    out = keyed.groupBy("key", "source_id").agg(*[F.min(F.when(g, row)).alias(name) for name, g in groups.items()], *[F.count_if(c).alias(name) for name, c in counts.items()])
    return out.select("source_id", "key", *counts, *groups)


def id_dedupe(listings: DataFrame, last: bool = False) -> DataFrame:
    """One listing per (source_id, external_id): the first, or the last's values at the first's place."""
    w = Window.partitionBy("source_id", "external_id")
    order = F.col("pos").desc() if last else F.col("pos").asc()
    return listings.withColumns({"_n": F.row_number().over(w.orderBy(order)), "_p": F.min("pos").over(w)}).where("_n = 1").withColumn("pos", F.col("_p")).drop("_n", "_p")


#: What the stream stores of a posting: texts lie in a table of their own, told by their hash; a ``tracked`` row was last seen when its source was.
SLIM = STATE.replace("description string", "text_hash string, tracked boolean")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def duplicate_keys(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("source_id", "key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def diff(snapshot: DataFrame, state: DataFrame) -> DataFrame:
    """(source_id, key, s, f, change, fields): s the stored row, f the fetched one; ``snapshot`` is keyed, one row a key."""
    s = state.select("source_id", "key", F.struct(*[c for c in state.columns]).alias("s"))
    f = snapshot.select("source_id", "key", F.struct(*[c for c in snapshot.columns]).alias("f"))
    return changed(f.join(s, ["source_id", "key"], "full_outer"))


def changed(both: DataFrame) -> DataFrame:
    """(source_id, key, s, f) with ``change`` and ``fields``; s or f is null where a side lacks the key."""
    differs = [F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")), F.lit(c)) for c in NEWSWORTHY]
    fields = F.filter(F.array(*differs), lambda x: x.isNotNull())
    change = (
        F.when(F.col("s").isNull(), "new")
        .when(F.col("f").isNull(), F.when(F.col("s.state") == "open", "vanished").otherwise("absent"))
        .when(F.col("s.state") == "closed", "reposted")
        .when(F.size(fields) > 0, "updated")
        .otherwise("unchanged")
    )
    return both.withColumn("fields", fields).withColumn("change", change)


def guard(changes: DataFrame, sizes: DataFrame, sources: DataFrame, ratio: float = 0.5) -> DataFrame:
    """(source_id, open_before, vanished, size, accepted): sources whose snapshot would close too much are refused.

    ``sizes``: (source_id, size), filtered rows before key dedupe. ``sources``: (source_id, complete, rebaseline).
    """
    per = changes.groupBy("source_id").agg(F.count_if(F.col("s.state") == "open").alias("open_before"), F.count_if(F.col("change") == "vanished").alias("vanished"))
    out = sources.join(per, "source_id", "left").join(sizes, "source_id", "left").fillna(0, ["open_before", "vanished", "size"])
    return out.withColumn("accepted", accepts(ratio))


def accepts(ratio: float = 0.5) -> Column:
    """Over (complete, rebaseline, open_before, vanished, size): whether the snapshot may be applied."""
    small, few = F.col("open_before") < MIN_BOARD, F.col("vanished") <= F.lit(ratio) * F.col("open_before")
    return F.col("rebaseline") | ~F.col("complete") | (F.col("open_before") == 0) | ((F.col("size") > 0) & (small | few))


def flagged(changes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Changes with ``accepted`` and ``may_close`` of their source."""
    v = verdicts.select("source_id", "accepted", (F.col("accepted") & F.col("complete") & ~F.col("rebaseline")).alias("may_close"))
    return changes.join(v, "source_id")


def roll_forward(flags: DataFrame, as_of: Column, schema: str = STATE) -> DataFrame:
    """The next state. Refused sources keep theirs; columns that users own are never written from a snapshot. ``schema`` may be ``SLIM``, if both sides of the diff are."""
    kept = flags.where(F.col("s").isNotNull() | (F.col("accepted") & F.col("f").isNotNull()))
    return kept.select("source_id", "key", *rolled(as_of, schema))


def rolled(as_of: Column, schema: str = STATE) -> list[Column]:
    """Columns of the next state (but source and key) over flagged changes."""
    s, f = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"f.{c}"))
    new, back = F.col("change") == "new", F.col("change") == "reposted"
    here = F.col("accepted") & F.col("f").isNotNull()
    gone = F.col("accepted") & (F.col("change") == "vanished")
    closing = gone & F.col("may_close")
    pick = lambda fetched, stored: F.when(here, fetched).otherwise(stored)
    cols = {c: pick(f(c), s(c)) for c in REFRESHED}
    cols |= {
        "company": F.when(here & new, f("company")).otherwise(s("company")),
        "posted_at": F.when(here & new, F.coalesce(f("posted_at"), as_of)).when(here & back, F.coalesce(f("posted_at"), s("posted_at"))).otherwise(s("posted_at")),
        "posted_at_exact": F.when(here & (new | back), f("posted_at").isNotNull()).otherwise(s("posted_at_exact")),
        "first_seen": F.when(here & new, as_of).otherwise(s("first_seen")),
        "last_seen": pick(as_of, s("last_seen")),
        "state": F.when(here, "open").when(closing, "closed").otherwise(s("state")),
        "closed_at": F.when(here, F.lit(None)).when(closing, as_of).otherwise(s("closed_at")),
        "repost_count": F.when(here & new, 0).when(here & back, s("repost_count") + 1).otherwise(s("repost_count")),
        "stale_notified_at": F.when(here & (new | back), F.lit(None)).otherwise(s("stale_notified_at")),
        "deadline_notified_at": F.when(here & (new | back), F.lit(None)).otherwise(s("deadline_notified_at")),
    }
    cols |= {c: s(c) for c in OURS}
    types = [x.strip().split() for x in schema.split(",")]
    if "tracked boolean" in schema:
        cols |= {"text_hash": pick(F.coalesce(f("text_hash"), s("text_hash")), s("text_hash")), "tracked": F.when(here, True).when(gone, False).otherwise(s("tracked"))}
    else:
        cols["description"] = pick(F.coalesce(f("description"), s("description")), s("description"))
    return [cols[n].cast(t).alias(n) for n, t in types[2:]]


def must_write() -> Column:
    """Over flagged changes of slim rows: whether the stored row differs in more than when it was last seen, which is its source's if it is tracked."""
    s, f = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"f.{c}"))
    moved = reduce(or_, [~s(c).eqNullSafe(f(c)) for c in REFRESHED]) | (f("text_hash").isNotNull() & ~s("text_hash").eqNullSafe(f("text_hash"))) | ~s("tracked")
    here = F.col("f").isNotNull() & (F.col("change").isin("new", "reposted") | moved)
    gone = (F.col("change") == "vanished") & (F.col("may_close") | s("tracked"))
    return F.col("accepted") & F.coalesce(here | gone, F.lit(False))


def state_columns() -> list[str]:
    return [x.strip().split()[0] for x in STATE.split(",")]


def change_events(flags: DataFrame, as_of: Column, cycle_id: str) -> DataFrame:
    """Opened, updated, reposted, closed and vanished-while-claimed events with their payload columns and JSON."""
    ok = flags.where("accepted")
    held = F.col("s.claimed_by").isNotNull() & F.col("s.applied_at").isNull()
    closing = (F.col("change") == "vanished") & F.col("may_close")
    kind = F.when(F.col("change").isin("new", "updated"), "posting_opened").when(F.col("change") == "reposted", "posting_reposted").when(closing & held, "vanished_while_claimed").when(closing, "posting_closed")
    payload = (
        F.when(F.col("change") == "new", F.lit("{}"))
        .when(F.col("change") == "updated", F.to_json(F.struct(F.lit(True).alias("update"), F.col("fields"))))
        .when(F.col("change") == "reposted", F.to_json(F.struct(F.col("gap_days").alias("gapDays"), F.col("s.external_id").alias("previousExternalId"))))
        .when(kind == "vanished_while_claimed", F.to_json(F.struct(F.col("s.claimed_by").alias("claimedBy"), F.col("days_held").alias("daysHeld"))))
        .otherwise(F.to_json(F.struct(F.col("s.applied_at").isNotNull().alias("applied"))))
    )
    out = ok.withColumns({"gap_days": elapsed_days(F.col("s.closed_at"), as_of), "days_held": elapsed_days(F.col("s.claimed_at"), as_of)}).where(kind.isNotNull())
    return out.select(event_id(cycle_id, kind).alias("event_id"), "source_id", "key", kind.alias("type"), "change", "fields", "gap_days", "days_held", payload.alias("payload"), as_of.alias("created_at"))


def event_id(cycle_id: str, kind: Column) -> Column:
    """The same for a retried cycle, so appending again can be recognised."""
    return F.sha2(F.concat_ws("|", F.lit(cycle_id), F.col("source_id"), F.col("key"), kind), 256)


def poll_report(flags: DataFrame, filtered: DataFrame) -> DataFrame:
    """Per source: seen, filtered, opened (new and reposted), updated, closed, refused. ``filtered``: (source_id, filtered)."""
    ok = F.col("accepted")
    per = flags.groupBy("source_id").agg(
        F.count_if(F.col("f").isNotNull()).alias("seen"),
        F.count_if(ok & F.col("change").isin("new", "reposted")).alias("opened"),
        F.count_if(ok & (F.col("change") == "updated")).alias("updated"),
        F.count_if(F.col("may_close") & (F.col("change") == "vanished")).alias("closed"),
        F.bool_or(~ok).alias("refused"),
    )
    return per.join(filtered, "source_id", "left").fillna(0, ["filtered"])


def totals(report: DataFrame) -> DataFrame:
    return report.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("seen", "filtered", "opened", "updated", "closed")], F.count_if("refused").alias("refused"))


def mark_polled(sources: DataFrame, status: DataFrame, as_of: Column) -> DataFrame:
    """Failure counter, etag and last poll. ``status``: (source_id, status ok | not_modified | failed | refused, etag)."""
    j = sources.join(status.withColumnRenamed("etag", "new_etag"), "source_id", "left")
    good, bad = F.col("status").isin("ok", "not_modified"), F.col("status").isin("failed", "refused")
    return j.withColumns(
        {
            "fail_count": F.when(good, 0).when(bad, F.col("fail_count") + 1).otherwise(F.col("fail_count")),
            "etag": F.when(good, F.coalesce("new_etag", "etag")).otherwise(F.col("etag")),
            "last_poll": F.when(good, as_of).otherwise(F.col("last_poll")),
        }
    ).drop("status", "new_etag")


def high_fit(scored: DataFrame, as_of: Column, threshold: int = 75, fresh_hours: int = 48) -> DataFrame:
    hours = elapsed_hours(F.col("posted_at"), as_of)
    return scored.where((F.col("fit_score") >= threshold) & F.col("posted_at_exact") & (hours <= fresh_hours)).withColumn("age_hours", hours)


def is_stale(as_of: Column, days: int) -> Column:
    """Open, claimed over ``days`` ago, not applied to, and not nudged yet."""
    return (F.col("state") == "open") & F.col("claimed_by").isNotNull() & F.col("applied_at").isNull() & F.col("stale_notified_at").isNull() & F.coalesce(F.col("claimed_at") < as_of - F.make_interval(days=F.lit(days)), F.lit(False))


def is_due(as_of: Column, days: int) -> Column:
    """Open, not applied to, closing within ``days``, and not nudged yet."""
    soon = (F.col("closes_at") > as_of) & (F.col("closes_at") <= as_of + F.make_interval(days=F.lit(days)))
    return (F.col("state") == "open") & F.col("applied_at").isNull() & F.col("deadline_notified_at").isNull() & F.coalesce(soon, F.lit(False))


def stale_sweep(state: DataFrame, as_of: Column, days: int) -> DataFrame:
    return state.where(is_stale(as_of, days)).withColumn("days", elapsed_days(F.col("claimed_at"), as_of))


def deadline_sweep(state: DataFrame, as_of: Column, days: int) -> DataFrame:
    return state.where(is_due(as_of, days)).withColumn("days", elapsed_days(as_of, F.col("closes_at")))


def scoring_queue(state: DataFrame, budget: int = 25) -> DataFrame:
    return state.where("state = 'open' and fit_score is null and description is not null").orderBy(F.desc("posted_at"), F.desc("source_id"), F.desc("key")).limit(budget)


def newest_per_source(listings: DataFrame, budget: int = 25) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc_nulls_last("posted_at"), "pos"))
    return listings.withColumn("nth", nth).where(F.col("nth") <= budget)


def apply_actions(state: DataFrame, actions: DataFrame) -> DataFrame:
    """Latest claim/release and applied/undo of each posting. ``actions``: (source_id, key, ts, action, user)."""
    pick = lambda a, b: F.max(F.when(F.col("action").isin(a, b), F.struct("ts", "action", "user")))
    last = actions.groupBy("source_id", "key").agg(pick("claim", "release").alias("c"), pick("applied", "undo").alias("a"))
    j = state.join(last, ["source_id", "key"], "left")
    c = F.col("c.action").isin("claim", "release")
    a = F.col("a.action").isin("applied", "undo")
    return j.withColumns(
        {
            "claimed_by": F.when(c, F.when(F.col("c.action") == "claim", F.col("c.user"))).otherwise(F.col("claimed_by")),
            "claimed_at": F.when(c, F.when(F.col("c.action") == "claim", F.col("c.ts"))).otherwise(F.col("claimed_at")),
            "applied_at": F.when(a, F.when(F.col("a.action") == "applied", F.col("a.ts"))).otherwise(F.col("applied_at")),
        }
    ).drop("c", "a")


def cross_source(keyed: DataFrame) -> DataFrame:
    """Jobs that several sources list: one row a key, no self-join."""
    return keyed.groupBy("key_full").agg(F.count_distinct("source_id").alias("n_sources"), F.count(F.lit(1)).alias("n_listings")).where("n_sources > 1")


def source_health(sources: DataFrame, state: DataFrame, most: int = 5) -> DataFrame:
    n = state.where("state = 'open'").groupBy("source_id").agg(F.count(F.lit(1)).alias("open"))
    text = F.when(F.col("fail_count") >= most, "MUTED").when(F.col("last_poll").isNull(), "never polled").when(F.col("fail_count") > 0, F.concat(F.col("fail_count").cast("string"), F.lit(" failures"))).otherwise("ok")
    return sources.join(n, "source_id", "left").fillna(0, ["open"]).withColumn("health", text)


def quiet_groups(events: DataFrame) -> DataFrame:
    """Events that aren't alerts, one row a posting."""
    return events.where(~F.col("type").isin(*ALERTS)).groupBy("source_id", "key").agg(F.array_sort(F.collect_set("type")).alias("types"), F.count(F.lit(1)).alias("n_events"), F.min("created_at").alias("first_at"))
