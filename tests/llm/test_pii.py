import hashlib
import re

from pyspark.sql import functions as F

from tidemark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def brute(text):
    text = text or ""
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            x, d = m[0], re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(y) <= 255 for y in x.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


CASES = [
    None,
    "",
    "mail a@b.com-x@y.z and a@b.c_d@e.f, x@y no, é😀 bob.s+1@mail.example.org.",
    "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 000255.0.0.1 10.0.0.1",
    "card 4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 4 1 1",
    "tel +1 (988) 555-2485 or +49.30.123456 +1((( +12 ++33 1 23 45 67 89 ",
    'password=e3b3ed3cc8548923d6 token = "0641917ea4e9feb9cda83477b57ac2654884f485" call 212-555-0199 now',
    "😀" * 50 + " 192.168.0.1 " + "9" * 3000 + " a@" + "b" * 5000 + ".com",
    "@".join(["x1.y"] * 300),
    "+1 2" * 600,
    "jo (at) site (dot) com",
]


def test_base_spans_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)] + [(None, CASES[3], "y")], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.find_pii(docs).withColumn("joined", pii.joined(F.col("base"))).collect()}
    for i, t in enumerate(CASES):
        assert got[i].joined == ",".join(f"{k}:{s}:{e}" for s, _, e, k in brute(t)), i
    assert got[None].joined == got[3].joined


def test_query_and_added_spans(spark, tmp_path):
    rows = [(i, f'text {i} password=e3b3ed3cc85{i}8923d6 mail x{i}@mail.example.com +1 (988) 555-248{i % 10} 10.0.0.{i}') for i in range(30)] + [(99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.op2_pii(spark, str(tmp_path)).collect()}
    assert got[99].base_sha256 == hashlib.sha256(b"").hexdigest() and got[99].spans == ""
    for i in range(30):
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in brute(rows[i][1]))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(got[i].spans.split(","))
        assert "secret:" in got[i].spans
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(empty).count() == 0


def test_em_recovers_reliable_labelers():
    pats = [("email", (1, 1, 0, 1), 900), ("email", (-1, -1, 0, -1), 400), ("email", (1, -1, 0, 1), 30), ("email", (-1, 1, 1, -1), 20)]
    rel, prior = pii.fit_labelers(pats)
    assert 0.6 < prior["email"] < 0.75
    assert pii.posterior("email", (1, 1, 0, 1), prior, rel) > 0.95 > 0.05 > pii.posterior("email", (-1, -1, 0, -1), prior, rel)


def test_votes_turn_down_and_add(spark):
    import random

    rnd = random.Random(8)
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))

    def number(valid):
        while True:
            d = rnd.choice("456") + pick("0123456789", 15)
            if luhn(d) == valid:
                return d

    wanted, refused, rows = {}, {}, []
    for i in range(400):
        good = rnd.choice([f"token = \"{pick('0123456789abcdef', 40)}\"", f"API_KEY: {pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 24)}", f"{pick('abcdef', 6)} [at] {pick('abcdef', 7)} [dot] org", f"{rnd.randint(2, 9)}12-{rnd.randint(2, 9)}55-{pick('0123456789', 4)}"])
        bad = rnd.choice([number(False), f"{rnd.randint(256, 999)}.1.2.{rnd.randint(0, 255)}", "page=" + pick("0123456789", 9), "version: aaaaaaaaaaaa"])
        text = f"some words {number(True)} then {bad} more x{i}@mail.example.com and 10.2.3.{i % 250} call +1 (212) 555-0{i % 900:03d} so {good} end"
        rows.append((i, text))
        wanted[i], refused[i] = (text.index(good), text.index(good) + len(good)), (text.index(bad), text.index(bad) + len(bad))
    got = {r.doc_id: {(x["start"], x["end"]) for x in r.added} for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = sum(wanted[i] in got[i] for i in wanted) / len(rows)
    wrong = sum(bool(got[i] - {wanted[i]}) for i in got) / len(rows)
    assert recall >= 0.95 and wrong <= 0.05, (recall, wrong)
    assert sum(refused[i] in got[i] for i in refused) <= 0.02 * len(rows)


def test_long_secret_is_whole(spark):
    text = "token = \"" + "a1b2c3d4" * 200 + "\" and pw"
    r = pii.find_pii(spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")).first()
    assert [(x["kind"], x["start"], x["end"]) for x in r.added] == [("secret", 0, text.rindex("\"") + 1)]


def test_candidates_need_no_digit_elsewhere(spark):
    """A secret is a candidate whether or not its text holds a digit, and an obfuscated address in any case."""
    texts = ["api_key: sk_live_abcdefghijk end", "write jane [AT] example [DOT] org", "write jane(at)example.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {c.kind for c in r.cands} for r in pii.candidates(df).collect()}
    assert "secret" in got[0] and "email" in got[1] and "email" in got[2]
