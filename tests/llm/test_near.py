import random

import corpus_pipeline
from tidemark.llm import near as N


def sets_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_ids that stay: the smallest of each component of Jaccard >= 0.8, by comparing all pairs."""
    sets = [(d, sets_of(t)) for d, t in sorted(rows)]
    part = {d: d for d, _ in sets}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if 5 * len(x & y) >= 4 * len(x | y) and part[a] != part[b]:
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {d: new if p == old else p for d, p in part.items()}
    return {d for d, p in part.items() if d == p}


def planted(rnd):
    word = lambda: f"w{rnd.randrange(3000)}"
    line = " ".join(word() for _ in range(30))
    rows = []
    for base in range(40):
        text = [word() for _ in range(rnd.choice([3, 8, 40, 150, 400]))] + line.split() * (base % 3 == 0)
        for copy in range(4):
            rows.append((100 * base + copy, " ".join(text)))
            for _ in range(rnd.randint(0, max(1, len(text) // 40))):  # each copy is edited further: chains
                text[rnd.randrange(len(text))] = word()
    return rows


def test_stage_against_all_pairs(spark, tmp_path):
    rows = planted(random.Random(3)) + [(9000, None), (9001, " \n"), (9002, "a b"), (9003, "A  b")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, lang string")
    out = corpus_pipeline.simhash_stage(spark, docs, str(tmp_path))
    got = sorted(r.doc_id for r in out.collect())
    want = brute(rows)
    assert got == sorted(want) and out.columns == docs.columns
    assert 40 < len(want) < len(rows) - 40


def test_order_is_free_and_large_class(spark, monkeypatch):
    rnd = random.Random(5)
    text = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(text[:j] + [f"n{i}"] + text[j:])) for i, j in ((i, rnd.randrange(200)) for i in range(60))]
    rows += [(100 + i, " ".join(text[:100] + [f"m{i}.{j}" for j in range(100)])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sample, common, rounds in ((1, 2, 8), (1, 10**6, 1)):
        monkeypatch.setattr(N, "SAMPLE", sample)
        monkeypatch.setattr(N, "ROUNDS", rounds)
        monkeypatch.setattr(N, "COMMON", common)
        assert {r.doc_id for r in N.keep_first(docs).collect()} == brute(rows)


def test_equal_and_null_ids(spark):
    rows = [(None, "a b c", 1), (None, "a b c", 2), (7, "d e f", 1), (7, "d e f", 2), (7, "g h i", 3), (8, "A b c", 1)]
    got = N.keep_first(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(7, "d e f"), (7, "g h i"), (8, "A b c")]
    assert N.keep_first(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_half_hashes_decide_nothing_alone(spark, monkeypatch):
    """Pairs that half hashes leave open are decided on the whole sets."""
    import random

    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(120)]
    texts = [" ".join(base)] + [" ".join(base[:k] + [r.choice(words) for _ in range(120 - k)]) for k in range(60, 120, 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = N.stored(N._prefixes(docs), "near-prefixes")
    sigs = {x.doc_id: x.sig for x in rows.collect()}
    pairs = spark.createDataFrame([(sigs[0], sigs[i]) for i in range(1, len(texts))], "a long, b long")
    sets = [set(N.shingles(t).tolist()) for t in texts]
    want = {sigs[i] for i in range(1, len(texts)) if 5 * len(sets[0] & sets[i]) >= 4 * len(sets[0] | sets[i])}
    monkeypatch.setattr(N, "SLACK", 10_000)  # no pair counts as certain: all are decided on the whole hashes
    assert {x.b for x in N._alike(pairs, docs, rows).collect()} == want and want and len(want) < len(texts) - 1
