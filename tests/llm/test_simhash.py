import random

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import near as N
from tidemark.llm import simhash as S


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_links(fps):
    fps = sorted(set(fps))
    return {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}


def test_fingerprints():
    for t in [None, "", " \t", "a", "A b c", "one two three four five", "Ünï cödé x y z w " * 9, "w%d " * 300]:
        assert S.fingerprint_of(t) & (2**64 - 1) == brute_fp(t)


def test_every_close_pair_has_a_valid_chain():
    rnd = random.Random(3)
    for _ in range(3000):
        d = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4)))
        assert any(all((d & S.chain_mask(i, n)).bit_count() <= 4 * n // 5 for n in range(1, 6)) for i in range(5))


def clusters(rnd, n):
    out = []
    for _ in range(n):
        c = rnd.getrandbits(64)
        out += [c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(12)]
    return [S._signed(x) for x in out] + [0, -1, 1, S._signed(1 << 63)]


def test_links_against_brute_force(spark, monkeypatch):
    fps = sorted(set(clusters(random.Random(5), 25)))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = brute_links(fps)
    for hot in (1024, 3):
        monkeypatch.setattr(S, "HOT", hot)
        got = [tuple(sorted((r.x, r.y))) for r in S.links(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_and_stage(spark, tmp_path):
    rnd = random.Random(1)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(300)) for _ in range(20)]
    rows = [(100 + i, t, "x") for i, t in enumerate(texts)]
    rows += [(i, texts[i] + " tail", "copy") for i in range(5)] + [(50 + i, texts[7], "copy") for i in range(6)] + [(200, None, "n"), (201, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in S.op4_simhash(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    fp = {d: brute_fp(t) for d, t, _ in rows}
    part = {d: d for d in fp}
    for _ in range(len(rows)):
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 4:
                    part[a] = part[b] = min(part[a], part[b])
    for d in fp:
        assert got[d].fingerprint == f"{fp[d]:016x}" and got[d].component_id == part[d]
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(part.values()))
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, texts[3] + " z q r s t u v w", "a")] * 2, docs.schema))
    ids = [r.doc_id for r in S.keep_first(twice).collect()]
    assert sorted(x for x in ids if x is not None) == sorted(set(part.values()))
    assert S.near_classes(docs.where(F.lit(False))).count() == 0


def test_one_row_of_each_class_and_no_text_is_lost(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, 7), (None, a, 7), (1, b, 7), (5, b, 7), (5, c, 7), (5, c, 8), (None, c + " z", 7), (None, "only null", 7), (None, "only null", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _w_row int")
    for keep in (S.keep_first, N.keep_first):
        out = keep(docs)
        assert out.columns == docs.columns and all(r[2] in (7, 8) for r in out.collect())
        assert sorted(((r.doc_id or 0), r.text) for r in out.collect()) == sorted([(1, a), (1, b), (5, c), (0, "only null")])
