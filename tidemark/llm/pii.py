"""Personal data: weak-supervision span finding, in DataFrame functions only.

Base spans come from four patterns with checks and always stay. Further candidates come from looser
patterns (national phone numbers, obfuscated addresses, key=value secrets and base
matches that failed their check). Four labelers vote +1, 0 or -1 on every candidate:

* pattern: the kind's strict pattern and check,
* gazetteer: mail providers and top-level domains, card issuer ranges, country and area codes, reserved address blocks, names of secrets and of plain values,
* context: trigger words shortly before the span, or what makes them unlikely,
* shape: variety of characters.

Expectation-maximisation over the counts of distinct vote patterns (at most 3^4 for each
kind, whatever the corpus size) estimates each labeler's reliability and each kind's prior.
The posteriors are soft labels for a naive-Bayes span classifier on features of the span
(kind, length, neighbours, digits, whether its check holds, what the gazetteer and its characters say), whose counts are one aggregation over all candidates. A candidate the
classifier puts at one half or more is added, unless it overlaps a base span; so numbers that fail their check and values with plain names are turned down.

Defined results: null text is empty text (no spans, the digest of the empty string); very
long texts are read whole, in linear time (possessive patterns anchored at
run starts); repeated rows give repeated results; ties in start are ordered
by kind; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

# The base patterns, written without backtracking. \G and the look-behind start a
# match at the start of a run of its characters or where the match before ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser candidates that only the votes can turn into spans, of any length.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{2,}+)++",
    "phone": r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?i)(?<![a-z0-9_])(?:[a-z0-9]++[_-])*+(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|id|key|page|session|hash|version)\s*+[=:]\s*+[\"']?[A-Za-z0-9_./+-]{8,}+[\"']?",
}
#: Kinds in the order that breaks ties of start.
KINDS = ("email", "ip", "card", "phone", "secret")
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# What the gazetteer knows.
#: Mail domains of large providers, and the top-level domains of most of the web (two letters stand for a country).
PROVIDERS = ("gmail", "googlemail", "yahoo", "ymail", "outlook", "hotmail", "live", "msn", "icloud", "aol", "gmx", "web", "t-online", "orange", "free", "laposte", "proton", "protonmail", "mail", "zoho", "yandex", "qq", "163", "126", "naver", "fastmail", "tutanota", "comcast", "verizon", "btinternet")
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "app", "dev", "cloud", "online", "site", "tech", "xyz")
#: Issuer prefixes of payment cards and their lengths.
ISSUERS = (
    r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})",
    r"(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}",
    r"3[47][0-9]{13}",
    r"(?:6011|64[4-9][0-9]|65[0-9]{2})[0-9]{12,15}",
    r"35(?:2[89]|[3-8][0-9])[0-9]{12,15}",
    r"3(?:0[0-5]|[689][0-9])[0-9]{11,16}",
    r"62[0-9]{14,17}",
    r"(?:50|5[6-8]|6[0379])[0-9]{10,17}",
)
#: Country calling codes.
CALLING = r"1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|35|37|38|42|50|59|6[7-9]|80|85|87|88|96|97|99)[0-9]"
#: Address blocks that belong to no one in particular.
RESERVED = r"^(?:0|10|127|22[4-9]|2[3-5][0-9]|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7]))\."
#: Names of values that are secrets, names of values that aren't, and how known kinds of tokens begin.
SECRET_NAMES = r"(?i)^(?:[a-z0-9]++[_-])*?(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]"
PLAIN_NAMES = r"(?i)^(?:page|id|version|hash)\s*[=:]"
TOKEN_STARTS = r"[=:]\s*[\"']?(?:gh[opsu]_|github_pat_|AKIA|ASIA|sk_live_|sk-|xox[abpr]-|glpat-|AIza|eyJ)"
TRIGGERS = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|@)",
    "ip": r"(?i)(?:\bip\b|host|addr|server|client)",
    "card": r"(?i)(?:card|visa|master|payment|credit)",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|contact)",
    "secret": r"(?i)(?:login|auth|credential|export|config|env|secret|bearer)",
}
LABELERS = ("pattern", "gazetteer", "context", "shape")
BLOCK = 256


def prefix_sums(lengths: Column) -> Column:
    """Running totals of an array of numbers, block by block (no copy of the whole array for each element)."""
    blocks = F.sequence(F.lit(0), F.call_function("div", F.size(lengths) - 1, F.lit(BLOCK)).cast("int"))
    part = lambda k: F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK))
    none = F.array().cast("array<bigint>")
    state = lambda at: F.struct(at.cast("long").alias("at"), none.alias("out"))
    push = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out"))
    sums = F.transform(blocks, lambda k: F.aggregate(part(k), F.lit(0).cast("long"), lambda a, x: a + x))
    upto = F.aggregate(sums, state(F.lit(0)), push, lambda s: s["out"])
    pairs = F.transform(F.arrays_zip(blocks.alias("k"), upto.alias("u"), sums.alias("s")), lambda b: F.aggregate(part(b["k"]), state(b["u"] - b["s"]), push, lambda s: s["out"]))
    return F.when(F.size(lengths) == 0, none).otherwise(F.flatten(pairs))


def _with_matches(df: DataFrame, name: str, pattern: str, needle: str | None = None) -> DataFrame:
    """Column ``name``: array of (start, end, text) of the leftmost non-overlapping matches, in code points. ``needle`` matches in every text that the pattern matches in, and spares the others the work."""
    text = F.col("_text")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cut = F.split(text, pattern, -1)
    if needle:
        some = text.rlike(needle)
        found = F.when(some, found).otherwise(F.array().cast("array<string>"))
        cut = F.when(some, cut).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_m", found).withColumn("_p", F.when(F.size("_m") > 0, cut).otherwise(F.array().cast("array<string>")))
    # what lies before match i, beginning where match i-1 began
    step = F.transform(F.col("_m"), lambda m, i: F.length(F.get(F.col("_p"), i)) + F.when(i > 0, F.length(F.get(F.col("_m"), i - 1))).otherwise(0))
    df = df.withColumn("_s", step).withColumn("_at", prefix_sums(F.col("_s")))
    out = F.transform(F.col("_m"), lambda m, i: F.struct(F.get(F.col("_at"), i).alias("start"), (F.get(F.col("_at"), i) + F.length(m)).alias("end"), m.alias("text")))
    return df.withColumn(name, out).drop("_m", "_p", "_s", "_at")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = _digits(x)

    def add(acc: Column, i: Column) -> Column:
        v = d.substr(F.length(d) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + v - F.when(v > 9, 9).otherwise(0)

    return F.length(d).between(12, 19) & (F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(F.length(d), F.lit(1)), F.lit(19))), F.lit(0), add) % 10 == 0)


CHECKS = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"),
    "card": _luhn,
    "phone": lambda x: F.length(_digits(x)).between(9, 15),
}


def _votes(kind: str, x: Column, before: Column, strict: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate."""
    d = _digits(x)
    yes = lambda c: F.when(c, 1).otherwise(-1)
    top = rf"(?i)(?:^|[@.\])t])\s?(?:(?:{'|'.join(PROVIDERS)})[.\[( ].*|.*[.)\]]\s?(?:{'|'.join(TOP_LEVEL)}|[a-z]{{2}}))$"
    gazetteer = {
        "email": F.when(x.rlike(top), 1).otherwise(-1),
        "ip": F.when(x.rlike(RESERVED), -1).otherwise(1),
        "card": yes(d.rlike(rf"^(?:{'|'.join(ISSUERS)})$")),
        "phone": F.when(x.startswith("+"), yes(d.rlike(rf"^(?:{CALLING})"))).otherwise(yes(d.rlike("^[2-9][0-9]{2}[2-9]"))),
        "secret": F.when(x.rlike(SECRET_NAMES) | x.rlike(TOKEN_STARTS), 1).when(x.rlike(PLAIN_NAMES), -1).otherwise(0),
    }[kind]
    context = F.when(before.rlike(TRIGGERS[kind] + r"\W{0,3}(?:\w{1,12}\W{1,3})?$"), 1).when(before.rlike(r"(?:[#=/]|(?i)version|isbn|page)\s?$"), -1).otherwise(0)
    value = F.regexp_replace(x, r"^[^=:]*[=:]\s*", "") if kind == "secret" else x if kind == "email" else d
    varied = F.size(F.array_distinct(F.split(value, ""))) >= (8 if kind == "secret" else 4)
    shape = yes(varied & value.rlike("[0-9]") & value.rlike("[A-Za-z]")) if kind == "secret" else F.when(varied, 0).otherwise(-1)
    return {"pattern": strict, "gazetteer": gazetteer, "context": context, "shape": shape}


def _candidate(kind: str, m: Column, strict: Column) -> Column:
    """(kind, start, end, votes, features) of a candidate."""
    text = F.col("_text")
    # 24 code points before the span, one after
    at = F.greatest(m["start"] - 23, F.lit(1).cast("long")).cast("int")
    before = text.substr(at, (m["start"] + 1 - at).cast("int"))
    after = text.substr((m["end"] + 1).cast("int"), F.lit(1))
    votes = _votes(kind, m["text"], before, strict)
    side = lambda c: F.when(c == "", "none").when(c.rlike("^[A-Za-z]$"), "letter").when(c.rlike("^[0-9]$"), "digit").when(c.rlike(r"^\s$"), "space").otherwise("sign")
    bucket = lambda n: F.least(F.call_function("div", n.cast("long"), F.lit(4).cast("long")), F.lit(16).cast("long")).cast("string")
    features = F.array(
        F.lit(f"{kind}"),
        F.concat(F.lit(f"{kind}:length:"), bucket(F.length(m["text"]))),
        F.concat(F.lit(f"{kind}:digits:"), bucket(F.length(_digits(m["text"])))),
        F.concat(F.lit(f"{kind}:before:"), side(F.right(before, F.lit(1)))),
        F.concat(F.lit(f"{kind}:after:"), side(after)),
        F.concat(F.lit(f"{kind}:first:"), side(F.left(m["text"], F.lit(1)))),
        F.concat(F.lit(f"{kind}:check:"), strict.cast("string")),
        F.concat(F.lit(f"{kind}:known:"), votes["gazetteer"].cast("string")),
        F.concat(F.lit(f"{kind}:varied:"), votes["shape"].cast("string")),
    )
    return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.struct(*[votes[k].cast("int").alias(k) for k in LABELERS]).alias("votes"), features.alias("features"))


def _voted(kind: str, found: Column, check=None) -> Column:
    return F.transform(found, lambda m: _candidate(kind, m, F.when(check(m["text"]), 1).otherwise(-1) if check else F.lit(0)))


def candidates(documents: DataFrame) -> DataFrame:
    """Per document: ``base`` spans (kind, start, end) and ``cands``, the voted candidates, base ones included."""
    df = documents.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    for kind, pattern, needle in (("email", EMAIL, "@"), ("ip", IP, "[0-9]"), ("card", CARD, "[0-9]"), ("phone", PHONE, r"\+")):
        df = _with_matches(df, f"_{kind}", pattern, needle)
    for kind, needle in (("email", r"(?i)[\[(]at[\])]"), ("phone", "[0-9]"), ("secret", "[=:]")):
        df = _with_matches(df, f"_loose_{kind}", LOOSE[kind], needle)
    span = lambda kind: F.transform(F.filter(F.col(f"_{kind}"), lambda m: CHECKS[kind](m["text"])), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    base = F.concat(*[span(k) for k in KINDS[:4]])
    strict = [_voted(k, F.col(f"_{k}"), CHECKS[k]) for k in KINDS[:4]]
    # short digit runs are no candidates for anything
    strict[2] = _voted("card", F.filter(F.col("_card"), lambda m: F.length(_digits(m["text"])).between(12, 19)), _luhn)
    loose = [_voted(k, F.col(f"_loose_{k}")) for k in LOOSE]
    return df.select("doc_id", base.alias("base"), F.concat(*strict, *loose).alias("cands"))


#: What is thought of a labeler before any data, P(vote | truth). What a strict check is worth is known (one in ten numbers has a good check digit), so it isn't estimated.
CHECKED = {1: {1: 0.75, 0: 0.23, -1: 0.02}, 0: {1: 0.05, 0: 0.15, -1: 0.8}}
OTHERS = {1: {1: 0.6, 0: 0.25, -1: 0.15}, 0: {1: 0.15, 0: 0.25, -1: 0.6}}
#: That belief counts as so many of a kind's candidates: data may sharpen a labeler but not turn it round.
BELIEF = 0.2


def fit_labelers(patterns: list[tuple[str, tuple[int, ...], float]], rounds: int = 50) -> tuple[dict, dict]:
    """EM over (kind, votes, count): reliabilities {(kind, labeler, truth): {vote: probability}} and priors {kind: P(true)}."""
    rel, prior = {}, {}
    for kind in sorted({k for k, _, _ in patterns}):
        mine = [(votes, c) for k, votes, c in patterns if k == kind]
        n = sum(c for _, c in mine)
        start = {(j, t): dict((CHECKED if j == 0 else OTHERS)[t]) for j in range(len(LABELERS)) for t in (0, 1)}
        prior[kind] = 0.5
        rel |= {(kind, j, t): v for (j, t), v in start.items()}
        for _ in range(rounds):
            post = [posterior(kind, votes, prior, rel) for votes, _ in mine]
            prior[kind] = (sum(p * c for p, (_, c) in zip(post, mine, strict=True)) + 1) / (n + 2)
            for (j, t), before in start.items():
                if j == 0:
                    continue
                mass = {v: BELIEF * n * before[v] for v in (-1, 0, 1)}
                for p, (votes, c) in zip(post, mine, strict=True):
                    mass[votes[j]] += c * (p if t else 1 - p)
                total = sum(mass.values())
                rel[kind, j, t] = {v: m / total for v, m in mass.items()}
    return rel, prior


def posterior(kind: str, votes: tuple[int, ...], prior: dict, rel: dict) -> float:
    odds = math.log(prior[kind] / (1 - prior[kind]))
    odds += sum(math.log(rel[kind, j, 1][v] / rel[kind, j, 0][v]) for j, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def fit_classifier(cands: DataFrame, rel: dict, prior: dict) -> dict[str, float]:
    """Naive-Bayes log-odds for each feature value, from soft labels over all candidates."""
    odds = F.lit(0.0)
    for kind, p in prior.items():
        own = F.lit(math.log(p / (1 - p)))
        for j, name in enumerate(LABELERS):
            weight = {v: math.log(rel[kind, j, 1][v] / rel[kind, j, 0][v]) for v in (-1, 0, 1)}
            vote = F.col(f"c.votes.{name}")
            own = own + F.when(vote == 1, weight[1]).when(vote == -1, weight[-1]).otherwise(weight[0])
        odds = F.when(F.col("c.kind") == kind, own).otherwise(odds)
    soft = cands.select(F.explode("cands").alias("c")).select(F.col("c.features").alias("f"), (1 / (1 + F.exp(-odds))).alias("p"))
    rows = soft.select(F.explode("f").alias("f"), "p").groupBy("f").agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("n")).collect()  # one row a feature value: under 400
    by_kind = {r["f"]: (r["t"], r["n"]) for r in rows if ":" not in r["f"]}
    out = {}
    for r in rows:
        t, n = by_kind[r["f"].split(":")[0]]
        if ":" in r["f"]:
            out[r["f"]] = math.log((r["t"] + 0.5) / (t + 8)) - math.log((r["n"] + 0.5) / (n + 8))
        else:
            out[r["f"]] = math.log((t + 1) / (n + 1))
    return out


def find_pii(documents: DataFrame) -> DataFrame:
    """(doc_id, base, added) for every row: arrays of (kind, start, end), added ones found by the votes."""
    cands = stored(candidates(documents), "pii")
    votes = [F.col(f"c.votes.{name}").alias(name) for name in LABELERS]
    rows = cands.select(F.explode("cands").alias("c")).select(F.col("c.kind").alias("kind"), *votes).groupBy("kind", *LABELERS).count().collect()
    rel, prior = fit_labelers([(r["kind"], tuple(r[k] for k in LABELERS), r["count"]) for r in rows])
    weights = fit_classifier(cands, rel, prior) if rows else {}
    table = F.create_map(*[F.lit(x) for item in (weights or {"": 0.0}).items() for x in item])
    score = lambda c: F.aggregate(c["features"], F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))
    free = lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.filter(F.col("cands"), lambda c: free(c) & (score(c) >= 0))
    return cands.select("doc_id", "base", F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, then end; comma-joined."""
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_distinct(F.array_sort(order)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter(F.col("base"), lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[n(k) for k in KINDS[:4]],
        F.sha2(F.encode(joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
