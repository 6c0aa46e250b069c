"""Delivery: pending events, alerts, digests with a size budget, and the log of what was delivered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import age_label, trunc
from tidemark.operators.diff import ALERTS

MOST_LINES, MOST_CHARS, TAIL = 25, 4096, 40
DIGEST_ABOVE = 5


def pending(events: DataFrame, deliveries: DataFrame, most: int = 200) -> DataFrame:
    """The oldest undelivered events."""
    return events.join(deliveries.select("event_id"), "event_id", "left_anti").orderBy("created_at", "event_id").limit(most)


def split(events: DataFrame, state: DataFrame) -> DataFrame:
    """Events with their listing and ``route``: alert, quiet, or orphan if the listing is gone (those are only marked)."""
    j = events.join(state.select("source_id", "key", F.struct(*state.columns).alias("posting")), ["source_id", "key"], "left")
    return j.withColumn("route", F.when(F.col("posting").isNull(), "orphan").when(F.col("type").isin(*ALERTS), "alert").otherwise("quiet"))


def as_digest(quiet: DataFrame, above: int = DIGEST_ABOVE, *batch: str) -> DataFrame:
    """(n_postings, digest), one row (a batch, if columns tell batches): more listings than ``above`` go out as one digest."""
    return quiet.groupBy(*batch).agg(F.count_distinct("source_id", "key").alias("n_postings")).withColumn("digest", F.col("n_postings") > above)


def location_line() -> Column:
    place, away = F.nullif("location", F.lit("")), F.coalesce(F.col("remote"), F.lit(False))
    return F.when(away, F.concat_ws(" · ", place, F.lit("remote"))).otherwise(F.coalesce(place, F.lit("not stated")))


def status_line() -> Column:
    """What happened to a listing, joined; applied beats claimed."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return F.concat_ws(
        " · ",
        F.coalesce(F.concat(F.lit("applied "), day("applied_at")), F.concat(F.lit("claimed by "), F.col("claimed_by"))),
        F.when(F.col("repost_count") > 0, F.concat(F.lit("reposted "), F.col("repost_count").cast("string"), F.lit("×"))),
        F.concat(F.lit("closes "), day("closes_at")),
        F.when(F.col("state") == "closed", F.concat(F.lit("delisted "), day("closed_at"))),
    )


def digest_line(as_of: Column) -> Column:
    fit = F.coalesce(F.concat(F.lit("**"), F.col("fit_score").cast("string"), F.lit("**")), F.lit("—"))
    place = F.coalesce(trunc(F.nullif("location", F.lit("")), 28), F.when(F.col("remote"), "remote"))
    return F.concat(
        fit, F.lit(" · ["), trunc(F.col("title"), 60), F.lit("]("), F.col("url"), F.lit(") — "),
        F.concat_ws(" · ", trunc(F.col("company"), 32), place, age_label(F.col("posted_at"), as_of), F.concat(F.lit("`#"), F.col("key"), F.lit("`"))),
    )


def digest(rows: DataFrame, as_of: Column, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(rank, line, remaining): best fit first, unscored last, as many lines as fit the budget.

    The ranked rows are cut to ``MOST_LINES`` before the running length is summed; ``remaining`` counts the listings not shown.
    """
    best = rows.orderBy(F.desc_nulls_last("fit_score"), *order).limit(MOST_LINES).select("fit_score", *order, digest_line(as_of).alias("line"))
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("fit_score"), *order)))
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    shown = ranked.withColumn("_used", F.sum(F.length("line") + 1).over(upto)).where(F.col("_used") <= MOST_CHARS - TAIL)
    total = rows.agg(F.count(F.lit(1))).scalar()
    return shown.withColumn("remaining", total - F.count(F.lit(1)).over(Window.partitionBy())).select("rank", "line", "remaining")


def deliver(batch: DataFrame, send: Callable[[DataFrame], None], deliveries: str) -> None:
    """Send a pending batch, then log it: at least once, never marked before it was sent. Readers drop repeats by ``event_id``."""
    send(batch)
    batch.select("event_id", F.current_timestamp().alias("delivered_at")).write.mode("append").parquet(deliveries)
