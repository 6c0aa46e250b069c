"""One whole poll cycle over all sources: skip, filter, re-baseline, diff, guard, roll forward, events, report, source table; and the clock's nudges.

Every step is a DataFrame operation over all sources at once; a source's status decides what its rows may do, so a bad source can't touch another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import diff as D
from tidemark.operators import filters as FL

#: Takes a DataFrame and a name; gives the same rows.
Land = Callable[[DataFrame, str], DataFrame]


def kept_as_is(df: DataFrame, name: str) -> DataFrame:
    return df


EVENT = ("event_id", "source_id", "key", "type", "payload", "created_at")


@dataclass
class Cycle:
    """``state``: the next state; ``events``: see ``EVENT``; ``sources``: the next source table; ``report``: one row a source."""

    state: DataFrame
    events: DataFrame
    sources: DataFrame
    report: DataFrame


@dataclass
class Step:
    """What a cycle found: ``plan`` and ``verdict`` have a row a source, ``counts`` (source_id, size, filtered), ``flags`` the flagged changes."""

    plan: DataFrame
    counts: DataFrame
    verdict: DataFrame
    flags: DataFrame


def planned(sources: DataFrame, statuses: DataFrame, specs: DataFrame, most_failures: int = 5) -> DataFrame:
    """Sources with ``status`` (ok, not_modified, failed, or skipped: muted after too many failures), ``new_etag``, ``new_hash`` and ``rebaseline``.

    A source without a status has failed. A stored filter hash that is null or differs re-baselines the source.
    """
    s = statuses.select("source_id", F.col("status").alias("_s"), F.col("etag").alias("new_etag"))
    h = specs.select("source_id", F.col("filter_hash").alias("new_hash"))
    out = sources.join(s, "source_id", "left").join(h, "source_id", "left")
    status = F.when(F.col("fail_count") >= most_failures, "skipped").otherwise(F.coalesce("_s", F.lit("failed")))
    return out.withColumns({"status": status, "rebaseline": ~F.col("filter_hash").eqNullSafe(F.col("new_hash"))}).drop("_s")


def run_cycle(sources: DataFrame, statuses: DataFrame, listings: DataFrame, specs: DataFrame, state: DataFrame, as_of: Column, cycle_id: str, ratio: float = 0.5, most_failures: int = 5, land: Land = kept_as_is) -> Cycle:
    """Apply one cycle's snapshots.

    ``sources``: (source_id, complete, fail_count, etag, last_poll, filter_hash, ..); ``statuses``: (source_id, status, etag); ``listings``: all sources'
    rows, keyed or not; ``specs``: compiled, with ``filter_hash`` (see ``filters``). Only sources with status ok are diffed: a source that failed, is muted or wasn't modified keeps its state, and of these
    only the last has its poll recorded. A re-baseline closes nothing, isn't guarded, and stores its hash once the cycle went through. ``land`` may store what the results read more than once: plan, compiled specs, changes, counts and verdict.
    """
    plan = land(planned(sources, statuses, specs, most_failures), "plan")
    live = plan.where("status = 'ok'").select("source_id")
    step = compared(plan, listings, specs, state.join(live, "source_id", "left_semi"), as_of, ratio, land)
    return finished(step, state.join(live, "source_id", "left_anti"), sources, as_of, cycle_id)


def finished(step: Step, rest: DataFrame, sources: DataFrame, as_of: Column, cycle_id: str) -> Cycle:
    """The cycle of a step; ``rest``: stored rows of the sources that aren't diffed."""
    after = D.roll_forward(step.flags, as_of).unionByName(rest.select(*D.state_columns()))
    events = D.change_events(step.flags, as_of, cycle_id).select(*EVENT)
    return Cycle(after, events, *settled(step, sources, as_of))


def compared(plan: DataFrame, listings: DataFrame, specs: DataFrame, state: DataFrame, as_of: Column, ratio: float = 0.5, land: Land = kept_as_is) -> Step:
    """Filter the snapshots of sources with status ok and compare them with ``state``, which holds rows of no other source."""
    live = plan.where("status = 'ok'").select("source_id")
    specs = land(specs, "specs")
    matched = FL.matching(listings.join(live, "source_id", "left_semi"), specs, as_of)
    kept = matched.where("matches").select(*listings.columns)
    changes = land(D.diff(D.first_wins(kept), state), "changes")
    counts = land(matched.groupBy("source_id").agg(F.count_if("matches").alias("size"), F.count_if(~F.col("matches")).alias("filtered")), "counts")
    return judged(plan, changes, counts, ratio, land)


def judged(plan: DataFrame, changes: DataFrame, counts: DataFrame, ratio: float = 0.5, land: Land = kept_as_is) -> Step:
    """The step of ``changes`` of the sources with status ok, and of ``counts`` (source_id, size, filtered)."""
    live = plan.where("status = 'ok'").select("source_id", "complete", "rebaseline")
    verdict = land(D.guard(changes, counts.select("source_id", "size"), live, ratio), "verdict")
    return Step(plan, counts, verdict, D.flagged(changes, verdict))


def settled(step: Step, sources: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(next source table, report)."""
    done = step.plan.join(step.verdict.select("source_id", (~F.col("accepted")).alias("refused")), "source_id", "left")
    marked = D.mark_polled(
        done.select(*sources.columns),
        done.select("source_id", F.when(F.col("refused"), "refused").otherwise(F.col("status")).alias("status"), F.col("new_etag").alias("etag")),
        as_of,
    )
    hashes = done.select("source_id", F.when((F.col("status") == "ok") & ~F.col("refused"), F.col("new_hash")).alias("_h"))
    new_sources = marked.join(hashes, "source_id").withColumn("filter_hash", F.coalesce("_h", "filter_hash")).select(*sources.columns)
    per = D.poll_report(step.flags, step.counts.select("source_id", "filtered"))
    numbers = ("seen", "filtered", "opened", "updated", "closed")
    ok = F.col("status") == "ok"
    report = (
        done.select("source_id", "status", "rebaseline", "refused")
        .join(per.drop("refused"), "source_id", "left")
        .fillna(0, list(numbers))
        .select(
            "source_id", *numbers, (ok & F.col("rebaseline")).alias("rebaselined"), (F.col("status") == "not_modified").alias("not_modified"),
            ((F.col("status") == "skipped") | F.coalesce("refused", F.lit(False))).alias("skipped"),
            F.when(F.col("status") == "failed", "failed").when(F.col("refused"), "refused: mass delist guard").alias("error"),
        )
    )
    return new_sources, report


def scored(state: DataFrame, results: DataFrame, as_of: Column, cycle_id: str, threshold: int = 75, fresh_hours: int = 48) -> tuple[DataFrame, DataFrame]:
    """(state with this cycle's scores, high-fit events). ``results``: (source_id, key, result struct(score, reason)); a null result leaves its row unscored."""
    from tidemark.operators.scoring import merge_scores

    after = merge_scores(state, results, as_of)
    just = after.join(results.where("result is not null").select("source_id", "key"), ["source_id", "key"], "left_semi")
    fit = D.high_fit(just, as_of, threshold, fresh_hours)
    payload = F.to_json(F.struct(F.col("fit_score").alias("score"), F.lit(threshold).alias("threshold"), F.col("age_hours").alias("ageHours"), F.col("fit_reason").alias("reason")), {"ignoreNullFields": "false"})
    return after, _events(fit, "high_fit", payload, as_of, cycle_id)


def nudges(state: DataFrame, as_of: Column, cycle_id: str, stale_days: int = 14, deadline_days: int = 3) -> tuple[DataFrame, DataFrame]:
    """(state with the guards set, stale and deadline events): each posting is nudged once a life, as a repost clears its guards."""
    old, due = D.is_stale(as_of, stale_days), D.is_due(as_of, deadline_days)
    stale = _events(state.where(old), "stale", F.to_json(F.struct(F.lit(stale_days).alias("days"))), as_of, cycle_id)
    closes = F.date_format("closes_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    deadline = _events(state.where(due), "deadline", F.to_json(F.struct(closes.alias("closesAt"), F.lit(deadline_days).alias("days"))), as_of, cycle_id)
    return nudged(state, as_of, stale_days, deadline_days), stale.unionByName(deadline)


def nudged(state: DataFrame, as_of: Column, stale_days: int = 14, deadline_days: int = 3) -> DataFrame:
    """State with the guards of those set that are nudged now."""
    old, due = D.is_stale(as_of, stale_days), D.is_due(as_of, deadline_days)
    return state.withColumns({"stale_notified_at": F.when(old, as_of).otherwise(F.col("stale_notified_at")), "deadline_notified_at": F.when(due, as_of).otherwise(F.col("deadline_notified_at"))})


def _events(rows: DataFrame, kind: str, payload: Column, as_of: Column, cycle_id: str) -> DataFrame:
    return rows.select(D.event_id(cycle_id, F.lit(kind)).alias("event_id"), "source_id", "key", F.lit(kind).alias("type"), payload.alias("payload"), as_of.alias("created_at"))


def stream_of(*events: DataFrame) -> DataFrame:
    """All event streams of a cycle as one."""
    out = events[0].select(*EVENT)
    for e in events[1:]:
        out = out.unionByName(e.select(*EVENT))
    return out


def open_postings(state: DataFrame, mine: bool = False, most: int | None = None) -> DataFrame:
    """Open postings, newest first; ``mine``: claimed or applied ones; ``most``: a preview of so many."""
    rows = state.where("state = 'open'")
    if mine:
        rows = rows.where("claimed_by is not null or applied_at is not null")
    rows = rows.orderBy(F.desc("posted_at"), F.desc("source_id"), F.desc("key"))
    return rows if most is None else rows.limit(most)
