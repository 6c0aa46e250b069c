import hashlib
import random
import re

import pytest

from tidemark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, got = tokens(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    got |= wins[x]
        out[d] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(map(str, got))).encode()).hexdigest(), bool(hit))
    return out


def made(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["Ünï", "a", "B", "c9", "dé", "éÉ", "x"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 3, 10, 11, 25])))) for i in range(25)] + [(100, None), (101, "-- !")]
    docs = [(i, ", ".join(word() for _ in range(rnd.randint(0, 80)))) for i in range(60)]
    docs += [(100 + i, f"start\x85here {t or ''} {'y ' * i}") for i, t in items if i < 25]
    return docs + [(500, None), (501, "")], items


@pytest.mark.parametrize("size,vocabulary", [(1_000_000, 10**6), (50, 10**6), (50, 1)])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, size, vocabulary):
    monkeypatch.setattr(D, "SEGMENT_WORDS", size)
    monkeypatch.setattr(D, "VOCABULARY", vocabulary)
    monkeypatch.setattr(D, "BLOCK_PHRASES", 40 if size == 50 else 10**6)
    docs, items = made(size + vocabulary)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.op5_decontaminate(spark, str(tmp_path)).collect()}
    assert got == brute(docs, items)


def test_stage_near_and_empty(spark):
    docs = spark.createDataFrame([(1, "one two three four", "p"), (2, "nothing here", "q"), (None, "x one two three", "r"), (3, None, "s"), (3, "one two three", "t")], "doc_id long, text string, digest string")
    bench = spark.createDataFrame([(7, "One, TWO three")], "item_id long, text string")
    kept = D.drop_hits(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.digest) for r in kept.collect()) == [(2, "q"), (3, "s")]
    assert D.drop_hits(docs, bench.limit(0)).count() == 5
    assert D.contamination(docs.limit(0), bench).count() == 0
    hits = D.near(D.build_index(docs), ["four one", "three zebra"], 3).collect()
    assert [(r.doc_id, r.phrase, r.position) for r in hits] == [(1, 0, 3)]
    assert D.near(D.build_index(docs), ["four one"], 2).count() == 0


def test_clashing_names_and_a_long_text(spark):
    words = " ".join(f"w{i % 997}" for i in range(60_000))
    docs = spark.createDataFrame([(1, words + " one two three", 5, 6), (2, words, 5, 6)], "doc_id long, text string, _w_hit int, _hit_id int")
    bench = spark.createDataFrame([(7, "one two three"), (7, "one two three"), (8, "w3 zzz")], "item_id long, text string")
    kept = D.drop_hits(docs, bench)
    assert kept.columns == docs.columns and [(r.doc_id, r._w_hit, r._hit_id) for r in kept.collect()] == [(2, 5, 6)]
