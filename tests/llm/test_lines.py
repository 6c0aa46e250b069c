import random

from tidemark.llm import lines as L


def brute(rows):
    """First occurrence of every fingerprint, extended both ways, by plain loops."""
    docs = {}
    for d, k, t in rows:
        docs[d is not None, d or 0, k] = L.line_hashes(t)
    order = sorted(docs)
    first = {}
    for key in order:
        for g, i, _ in zip(*map(list, L.windows(*docs[key])), strict=True):
            first.setdefault(g, (key, i))
    gone = {}
    for key in order:
        h, c = docs[key]
        for g, i, _ in zip(*map(list, L.windows(h, c)), strict=True):
            src, j = first[g]
            if (src, j) == (key, i):
                continue
            s = docs[src][0]
            a = 0
            while i - a - 1 >= 0 and j - a - 1 >= 0 and h[i - a - 1] == s[j - a - 1]:
                a += 1
            b = 0
            while i + b < len(h) and j + b < len(s) and h[i + b] == s[j + b]:
                b += 1
            if sum(c[i - a : i + b]) >= L.MIN_WORDS:
                gone.setdefault(key, set()).update(range(i - a, i + b))
    return {k: sorted(v) for k, v in gone.items()}


def test_window_guarantee():
    rnd = random.Random(4)
    for _ in range(200):
        line = lambda: (rnd.getrandbits(60), rnd.choice([1, 4, 12, 26, 60]))
        run = [line() for _ in range(rnd.randint(1, 12))]
        if sum(c for _, c in run) < L.MIN_WORDS:
            continue
        marks = []
        for _ in range(2):
            doc = [line() for _ in range(rnd.randint(0, 5))] + run + [line() for _ in range(rnd.randint(0, 5))]
            marks.append(set(L.windows([h for h, _ in doc], [c for _, c in doc])[0].tolist()))
        assert marks[0] & marks[1]


def test_against_brute_force(spark):
    rnd = random.Random(9)
    line = lambda n: " ".join(f"w{rnd.randrange(9999)}" for _ in range(n))
    passages = [[line(rnd.choice([3, 9, 20, 55])) for _ in range(rnd.randint(1, 9))] for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [[line(rnd.choice([2, 15, 30]))], rnd.choice(passages), ["", line(4)], rnd.choice(passages)[rnd.randint(0, 3) :]]
        rows.append((i, "\n".join(x for p in parts for x in p), "extra"))
    rows += [(None, rows[5][1], "n"), (70, rows[7][1], "c"), (71, None, "z"), (72, "", "z"), (73, "short", "z"), (7, rows[7][1], "dup")]
    rows.append((80, "\n".join([line(30), line(30)] * 1 + [rows[3][1]] * 2), "self"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines string")
    keyed = docs.select("doc_id", L.row_key().alias("key"), "text").distinct().collect()
    want = brute([(r.doc_id, r.key, r.text) for r in keyed])
    got = {(r.doc_id is not None, r.doc_id or 0, r.key): list(r.lines) for r in L.repeated_lines(docs).collect()}
    assert got == want and len(want) > 20
    out = L.drop_repeats(docs)
    assert out.columns == docs.columns
    by = {(r.doc_id, r.lines): r.text for r in out.collect()}
    assert by[7, "extra"] == by[7, "dup"] and (71, "z") in by and (72, "z") in by and by[73, "z"] == "short"
    assert (70, "c") not in by
    key = {(r.doc_id, r.text): (r.doc_id is not None, r.doc_id or 0, r.key) for r in keyed}
    for d, t, x in rows:
        gone = want.get(key[d, t], [])
        left = [y for i, y in enumerate([y for y in (t or "").split("\n") if y.split()]) if i not in gone]
        if (d, x) in by and t:
            assert [y for y in by[d, x].split("\n") if y.split()] == left
        elif t:
            assert not left


def test_every_line_survives_somewhere(spark, tmp_path):
    rnd = random.Random(1)
    line = lambda n: " ".join(f"w{rnd.randrange(999)}" for _ in range(n))
    pool = [line(40) for _ in range(12)]
    rows = [(i, "\n".join(rnd.sample(pool, 5))) for i in range(40)] + [(99, pool[0] + "\n" + pool[1])] * 3
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {y for r in L.drop_repeats(docs).collect() for y in r.text.split("\n")}
    assert left == {y for _, t in rows for y in t.split("\n")}
    assert L.op10_lines(spark, str(tmp_path)).count() == len(rows)
    assert L.drop_repeats(docs.limit(0)).count() == 0


def test_clashing_names_and_equal_lines(spark):
    rnd = random.Random(6)
    line = lambda n: " ".join(f"w{rnd.randrange(9999)}" for _ in range(n))
    x, y = line(55), line(30)
    rows = [(1, x, 1, 2, 3, 4), (2, x + "\n" + y, 1, 2, 3, 4), (3, x + "\n" + y, 1, 2, 3, 4), (4, "\n".join([line(12)] * 20_000), 1, 2, 3, 4), (5, "\n".join(line(20) for _ in range(5000)), 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _w_gone int, _w_doc int, key int, __in_w_row int")
    out = L.drop_repeats(docs)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns and {tuple(r)[2:] for r in out.collect()} == {(1, 2, 3, 4)}
    assert got[1] == x and got[2] == y and 3 not in got and got[5] == rows[4][1]
    assert got[4] == rows[3][1].split("\n")[0]  # only the first of equal lines has no earlier copy
