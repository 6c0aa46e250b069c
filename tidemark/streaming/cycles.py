"""Whole poll cycles as a stream.

Landed pages arrive as rows (``store.PAGES``), in any number of batches. They are held until the row that ends their cycle (null source_id) is there;
then the cycle is applied by the same operators as a batch cycle: statuses from the pages and their completeness, filters, diff, guard, roll-forward, events, source table, and the
clock's nudges. All tables are committed together (``store.Store``). Cycles are numbered and applied in that order; one that is already committed,
or comes too late, changes nothing, so a batch run again after a failure does nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cycle as C
from tidemark.operators import diff as D
from tidemark.operators import names as N
from tidemark.operators.names import ENTRIES
from tidemark.sources import adapters
from tidemark.streaming.store import EVENTS, PAGES, SOURCES, Store, columns

#: Gives the compiled specs with ``filter_hash``, one row a source, for a source table.
Specs = Callable[[DataFrame], DataFrame]


def seed(store: Store, sources: DataFrame) -> None:
    """Add sources, (source_id, kind, ident, complete), that aren't there yet."""
    m = store.manifest()
    known = store.sources(m)
    fresh = sources.join(known, "source_id", "left_anti")
    fresh = fresh.select(*[F.col(c) if c in sources.columns else F.lit(0 if c == "fail_count" else None).cast(t).alias(c) for c, t in (x.strip().split() for x in SOURCES.split(","))])
    out = store.grown(m)
    out["sources"] = store.write("sources", known.unionByName(fresh), out["number"])
    store.publish(out)


def apply_cycle(store: Store, cycle: int, as_of: str, statuses: DataFrame, listings: DataFrame, specs: Specs, ratio: float = 0.5, nudge: tuple[int, int] | None = (14, 3), pages: list[str] | None = None) -> bool:
    """Apply one cycle; False if it is committed already. ``statuses``: (source_id, status, etag); ``listings``: rows of all sources. ``pages``: what is still held after it.

    Texts stay out of the diff: it compares their hashes, and the texts of rows whose hash is new are fetched from the snapshot afterwards. Only buckets with a source of
    status ok are read, and only rows that differ are written; nudges read the whole state, but not its texts.
    """
    m = store.manifest()
    if m["cycle"] is not None and cycle <= m["cycle"]:
        return False
    at, number, sources = F.lit(as_of).cast("timestamp"), m["number"] + 1, store.sources(m)
    try:
        compiled = store.scratch(specs(sources))
        plan = store.scratch(C.planned(sources, statuses, compiled))
        fresh = None
        if "key" not in listings.columns:  # only strings that no cycle had before are normalised
            listings = store.scratch(listings)
            fresh = store.write("names", N.normalised(N.missing(listings, store.names(m))), number)
            listings = N.keyed(listings, store.names(m).unionByName(store._frame([fresh], ENTRIES)))
        keyed = store.scratch(listings.withColumn("text_hash", D.text_hash(F.col("description"))))
        live = plan.where("status = 'ok'").select("source_id")
        state = store.state(m, store.buckets_of(live)).join(live, "source_id", "left_semi")
        step = C.compared(plan, keyed.drop("description"), compiled, state, at, ratio, lambda df, name: df if name == "specs" else store.scratch(df))
        must = step.flags.where(D.must_write())
        rows = must.select("source_id", "key", *D.rolled(at, D.SLIM))
        events = D.change_events(step.flags, at, str(cycle)).select(*C.EVENT)
        if nudge is not None:
            rows = store.scratch(rows)
            after = rows.unionByName(store.state(m).join(rows.select("source_id", "key"), ["source_id", "key"], "left_anti"))
            due = store.scratch(after.where(D.is_stale(at, nudge[0]) | D.is_due(at, nudge[1])))
            marked, told = C.nudges(due, at, str(cycle), *nudge)
            rows = marked.unionByName(rows.join(due.select("source_id", "key"), ["source_id", "key"], "left_anti"))
            events = events.unionByName(told)
        new_text = F.col("f.text_hash").isNotNull() & ~F.col("f.text_hash").eqNullSafe(F.col("s.text_hash"))
        texts = must.where(new_text).select("source_id", "key", F.col("f.pos").alias("pos"))
        said = keyed.select("source_id", "key", "pos", "description").join(texts, ["source_id", "key", "pos"]).select("source_id", "key", "description").dropDuplicates(["source_id", "key"])
        next_sources, _ = C.settled(step, sources, at)
        took = step.verdict.where("accepted").select("source_id", F.lit(True).alias("_took"))
        next_sources = next_sources.join(took, "source_id", "left").withColumn("seen_at", F.when(F.col("_took"), at).otherwise(F.col("seen_at"))).select(*columns(SOURCES))
        out = store.grown(m, state=store.write_keyed("state", rows, number), texts=store.write_keyed("texts", said, number))
        out["sources"] = store.write("sources", next_sources, number)
        out["events"] = store.write("events", events.select(*columns(EVENTS)), number)
        if fresh is not None and not store._frame([fresh], ENTRIES).isEmpty():
            out["names"].append(fresh)
        out |= {"cycle": cycle, "as_of": as_of, "pages": m["pages"] if pages is None else pages}
        store.publish(out)
    finally:
        store.swept()
    store.compact()
    return True


def amend(store: Store, change: Callable[[DataFrame], DataFrame], touched: DataFrame) -> None:
    """Write what ``change`` makes of the state rows of ``touched`` (source_id, key): user actions and scores. A commit of its own."""
    m = store.manifest()
    rows = store.state(m, store.buckets_of(touched)).join(touched.select("source_id", "key").distinct(), ["source_id", "key"], "left_semi")
    store.publish(store.grown(m, state=store.write_keyed("state", change(rows).select(*columns(D.SLIM)), m["number"] + 1)))


def act(store: Store, actions: DataFrame) -> None:
    """User actions, (source_id, key, ts, action, user)."""
    amend(store, lambda rows: D.apply_actions(rows, actions), actions)


def take(store: Store, rows: DataFrame, specs: Specs, nudge: tuple[int, int] | None = (14, 3), batch: list | None = None) -> list[int]:
    """Hold a batch of landed rows, and apply the cycles that have ended with it, in order; their numbers. ``batch``: (query, number), so that a batch that is held already isn't held twice."""
    m = store.manifest()
    behind = F.lit(False) if m["cycle"] is None else F.col("cycle") <= m["cycle"]
    if batch is None or m.get("batch") is None or m["batch"][0] != batch[0] or m["batch"][1] < batch[1]:
        fresh = store.write("pages", rows.select(*columns(PAGES)).where(~behind), m["number"] + 1)
        store.publish(store.grown(m) | {"pages": [*m["pages"], fresh], "batch": batch})
    held = store.manifest()["pages"]
    every = store.pages(store.manifest()).where(~behind)
    ends = every.where("source_id is null").groupBy("cycle").agg(F.max("as_of").cast("string").alias("as_of")).orderBy("cycle").collect()  # the few cycles that are held
    done = []
    for k, e in enumerate(ends):
        raw = every.where((F.col("cycle") == e["cycle"]) & F.col("source_id").isNotNull())
        spent = k == len(ends) - 1 and every.where(F.col("cycle") > e["cycle"]).isEmpty()
        if apply_cycle(store, e["cycle"], e["as_of"], adapters.statuses_of(raw), adapters.listings(raw.where("payload is not null")), specs, nudge=nudge, pages=[] if spent else held):
            done.append(e["cycle"])
    return done


def run(stream: DataFrame, store: Store, specs: Specs, checkpoint: str, nudge: tuple[int, int] | None = (14, 3)):
    """Start the query over a stream of ``store.PAGES`` rows."""

    def batch(rows: DataFrame, number: int) -> None:
        take(store, rows, specs, nudge, [rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), number])

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(store: Store, cycles: Iterable[tuple[int, str]], statuses: DataFrame, listings: DataFrame, specs: Specs, nudge: tuple[int, int] | None = None) -> list[int]:
    """Stored snapshots, with a column ``cycle``, applied one cycle after the other, all sources of a cycle at once. Each commit cuts the lineage."""
    return [n for n, at in sorted(cycles) if apply_cycle(store, n, at, statuses.where(F.col("cycle") == n).drop("cycle"), listings.where(F.col("cycle") == n).drop("cycle"), specs, nudge=nudge)]
