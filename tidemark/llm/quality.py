"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (+1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the counts of
distinct vote patterns (at most 3^10, whatever the corpus size) estimates each rule's
accuracy and the share of good documents; a document's posterior probability of being good
replaces "must pass every rule". Rules start from, and keep as ``BELIEF`` of the rows, the assumption that they are better than chance, so data can sharpen a rule but not turn it round.

Defined results: null and blank texts have no words, all counts are 0, and they fail
the base rule; texts are read whole; repeated rows get equal results; an empty table gives
no rows; a posterior of exactly one half is kept; extra columns pass through ``keep_good``
untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, aside, restored, stored, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Signals that only the votes use.
MORE = ("n_lines", "n_upper", "n_stops", "n_bangs", "n_clean", "n_common")
#: A word of letters and digits with ordinary punctuation around it.
CLEAN = r"^[\"'(\x{AB}\x{BB}\x{201C}\x{201E}\x{2018}\x{BF}\x{A1}]*[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}'\x{2019}.,:/@+-]*[.,;:?!)\"'\x{AB}\x{BB}\x{201D}\x{2026}]*$"
# Frequent words of the languages at hand, which running text doesn't do without.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "as", "with", "be", "by", "this", "are", "from", "at", "or", "an", "have", "not"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "wird", "sind"),
    "fr": ("le", "la", "les", "de", "et", "à", "en", "que", "qui", "dans", "pour", "par", "sur", "est", "du", "une", "un", "au", "pas", "plus", "avec", "elle"),
    "es": ("el", "los", "las", "que", "y", "del", "se", "con", "para", "por", "una", "su", "lo", "como", "más", "pero", "sus", "esta", "entre"),
}

BELIEF = 0.05


def _ratio(a: str, b: str) -> Column:
    return F.col(f"_w_{a}") / F.greatest(F.col(f"_w_{b}"), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """Votes from the signal columns; thresholds are fixed parameters."""
    n = F.col("_w_n_words")
    length, some = _ratio("word_chars", "n_words"), n > 0
    symbols, dup, rep = _ratio("n_symbols", "n_words"), _ratio("n_dup_lines", "n_lines"), _ratio("n_repeat_words", "n_words")
    upper, stops, bangs = _ratio("n_upper", "word_chars"), _ratio("n_stops", "n_words"), _ratio("n_bangs", "n_words")
    clean, common = _ratio("n_clean", "n_words"), _ratio("n_common", "n_words")
    return {
        "enough_words": _vote(n < 50, n >= 100),
        "word_length": _vote((length < 2.5) | (length > 12), length.between(3.0, 9.0) & some),
        "few_symbols": _vote(symbols > 0.1, (symbols <= 0.02) & some),
        "few_repeated_lines": _vote(dup > 0.3, (F.col("_w_n_lines") >= 3) & (dup <= 0.05)),
        "few_repeated_words": _vote(rep > 0.3, (rep <= 0.1) & some),
        "mostly_lower_case": _vote(upper > 0.3, (upper <= 0.15) & some),
        "sentences": _vote((stops < 0.01) & (n >= 50), stops.between(0.02, 0.5)),
        "few_exclamations": _vote(bangs > 0.2, (bangs <= 0.05) & some),
        "clean_words": _vote((clean < 0.6) & some, clean >= 0.85),
        "common_words": _vote((common < 0.04) & (n >= 50), common >= 0.1),
    }


def with_signals(df: DataFrame) -> DataFrame:
    """The input with signal columns ``_w_*`` of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumn("_w_w", words(F.col("text")))
    n = F.size("_w_w")
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w_w", i), F.get("_w_w", i + 1), F.get("_w_w", i + 2)))
    df = df.withColumn("_w_h", F.when(n >= 3, grams).otherwise(F.array().cast("array<bigint>")))
    # equal windows become neighbours; only texts that repeat a window are sorted
    again = F.size(F.array_distinct("_w_h")) < F.size("_w_h")
    ordered = F.sort_array(F.transform(F.col("_w_h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_w_s", F.when(again, ordered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    h_at = lambda k: F.get("_w_s", k)["h"]
    repeated = F.filter(F.col("_w_s"), lambda s, k: (s["h"] == F.coalesce(h_at(k + 1), s["h"] + 1)) | ((k > 0) & (s["h"] == F.coalesce(h_at(k - 1), s["h"] + 1))))
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))))
    df = df.withColumn("_w_l", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    signals = {
        "n_words": n,
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("_w_l") - F.size(F.array_distinct("_w_l")),
        "n_repeat_words": F.when(F.size("_w_s") > 0, covered).otherwise(0),
        "n_lines": F.size("_w_l"),
        "n_upper": F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
        "n_stops": F.regexp_count(text, F.lit(r"[.?](?:[\x20\x09-\x0D]|$)")),
        "n_bangs": F.regexp_count(text, F.lit("!")),
        "n_clean": F.size(F.filter(F.col("_w_w"), lambda w: w.rlike(CLEAN))),
        "n_common": F.size(F.filter(F.col("_w_w"), lambda w: w.isin(*sorted({x for ws in COMMON.values() for x in ws})))),
    }
    return df.withColumns({f"_w_{k}": v.cast("long") for k, v in signals.items()}).drop("_w_w", "_w_h", "_w_s", "_w_l")


def base_failed() -> Column:
    n = F.col("_w_n_words")
    return (n < 50) | (100 * F.col("_w_n_repeat_words") > 50 * n)


def fit_rules(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> tuple[float, list[dict]]:
    """EM over (votes, count): share of good documents, and for each rule {(truth, vote): probability}."""
    k = len(patterns[0][0]) if patterns else 0
    share, total = 0.8, sum(c for _, c in patterns)
    start = {(1, 1): 0.7, (1, 0): 0.25, (1, -1): 0.05, (0, 1): 0.3, (0, 0): 0.2, (0, -1): 0.5}
    rel = [dict(start) for _ in range(k)]
    for _ in range(rounds):
        post = [posterior(v, share, rel) for v, _ in patterns]
        good = sum(p * c for p, (_, c) in zip(post, patterns, strict=True))
        share = (good + 4) / (total + 5)
        for j in range(k):
            # the belief weighs with each class's own share, so the small class isn't held to it
            mass = {(t, v): p * (1 + BELIEF * (good if t else total - good)) for (t, v), p in start.items()}
            for p, (v, c) in zip(post, patterns, strict=True):
                mass[1, v[j]] += c * p
                mass[0, v[j]] += c * (1 - p)
            rel[j] = {(t, v): mass[t, v] / sum(mass[t, u] for u in (-1, 0, 1)) for t, v in mass}
    return share, rel


def posterior(votes: tuple[int, ...], share: float, rel: list[dict]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(rel[j][1, v] / rel[j][0, v]) for j, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def fitted(signals: DataFrame) -> Column:
    """Column of the posterior quality, fitted on all rows of ``signals`` by one aggregation over vote patterns."""
    names = list(rules())
    rows = signals.select(*[c.alias(k) for k, c in rules().items()]).groupBy(*names).count().collect()  # at most 3^10 rows
    share, rel = fit_rules([(tuple(r[k] for k in names), r["count"]) for r in rows])
    odds = F.lit(math.log(share / (1 - share)))
    if not rel:
        return F.lit(share)
    for j, vote in enumerate(rules().values()):
        weight = {v: math.log(rel[j][1, v] / rel[j][0, v]) for v in (-1, 0, 1)}
        odds = odds + F.when(vote == 1, weight[1]).when(vote == -1, weight[-1]).otherwise(weight[0])
    return 1 / (1 + F.exp(-odds))


def judge(documents: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, quality, kept) for every row."""
    signals = stored(with_signals(documents.select("doc_id", "text")).drop("text"), "quality")
    quality = fitted(signals)
    return signals.select("doc_id", *[F.col(f"_w_{k}").alias(k) for k in COUNTS], base_failed().alias("base_failed"), quality.alias("quality")).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are kept, with their columns. Signals are computed once and stored beside the rows."""
    signals = stored(with_signals(aside(documents)), "quality")
    return restored(signals.where(~base_failed() & (fitted(signals) >= 0.5)), documents)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "quality")
