"""Scoring of open listings by a scorer that the user plugs in: request text, answer parsing, merging."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What of a profile may be sent, and the longest profile, description and reason.
SECTIONS = ("resume", "work_eligibility", "application_answers")
MOST_PROFILE, MOST_DESCRIPTION, MOST_REASON = 8_000, 6_000, 300
NO_REASON = "no reason given"
INSTRUCTIONS = 'Rate from 0 to 100 how well this person meets the hard requirements of the job. Any missed one makes the score low. Answer with one JSON object only: {"score": integer, "reason": the deciding factor in 25 words}.'


def profile_text(profile: dict) -> str | None:
    """The allowed sections as JSON, cut; null if there are none. Who the person is never gets in."""
    kept = {s: profile[s] for s in SECTIONS if s in profile}
    return json.dumps(kept, indent=1, ensure_ascii=False)[:MOST_PROFILE] if kept else None


def request_text(profile: str, instructions: str = INSTRUCTIONS) -> Column:
    """Prompt over title, company, location and description."""
    head = f"{instructions}\n\nPROFILE\n{profile}\n\nJOB\nTitle: "
    return F.concat(
        F.lit(head), F.col("title"), F.lit("\nCompany: "), F.col("company"), F.lit("\nLocation: "), F.coalesce("location", F.lit("unstated")),
        F.lit("\nDescription:\n"), F.left(F.coalesce("description", F.lit("")), F.lit(MOST_DESCRIPTION)),
    )


def _refuse(name: str):
    raise ValueError(name)


def parse_answer(raw: str | None) -> tuple[int | None, str | None]:
    """(score, reason) of the first JSON object in an answer; (None, None) unless its score is a finite number."""
    start = -1 if raw is None else raw.find("{")
    if start < 0:
        return None, None
    try:
        found, _ = json.JSONDecoder(parse_constant=_refuse).raw_decode(raw, start)
    except (ValueError, RecursionError):
        return None, None
    score, reason = found.get("score"), found.get("reason")
    if isinstance(score, bool) or not isinstance(score, int | float) or not math.isfinite(score):
        return None, None
    text = reason.strip()[:MOST_REASON] if isinstance(reason, str) else ""
    return math.floor(min(100, max(0, score)) + 0.5), text or NO_REASON


def parsed_score(raw: Column) -> Column:
    """struct(score, reason), null if the answer can't be used."""

    @F.pandas_udf("score int, reason string")
    def parse(s: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([parse_answer(x) for x in s], columns=["score", "reason"])
        return out.astype({"score": "Int32", "reason": object})

    got = parse(raw)
    return F.when(got["score"].isNotNull(), got)


def overlap_score(profile: str) -> Column:
    """Example scorer without a model: the share of the description's distinct words that the profile has."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != ""))
    text = words(F.col("description"))
    share = F.floor(F.size(F.array_intersect(text, words(F.lit(profile)))) * 100 / F.greatest(F.size(text), F.lit(1)) + 0.5).cast("int")
    return F.when(F.col("description").isNotNull(), F.struct(share.alias("score"), F.lit("shared words").alias("reason")))


def merge_scores(state: DataFrame, scored: DataFrame, as_of: Column) -> DataFrame:
    """State with the scores of (source_id, key, result struct(score, reason)). A null result leaves the row unscored."""
    got = scored.where("result is not null").select("source_id", "key", F.col("result").alias("_r"))
    j = state.join(got, ["source_id", "key"], "left")
    new = F.col("_r").isNotNull()
    pick = lambda value, c: F.when(new, value).otherwise(F.col(c))
    return j.withColumns({"fit_score": pick(F.col("_r.score"), "fit_score"), "fit_reason": pick(F.col("_r.reason"), "fit_reason"), "fit_scored_at": pick(as_of, "fit_scored_at")}).drop("_r")
