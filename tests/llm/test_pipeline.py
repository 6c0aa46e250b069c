import random

import corpus_pipeline
from tidemark.llm import decontaminate, lines, quality, simhash
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute_fp


def documents(rnd):
    word = lambda: rnd.choice(["the", "an", "er"]) + str(rnd.randrange(4000))
    sent = lambda n: " ".join(word() for _ in range(n)) + "."
    bench = [(i, sent(30)) for i in range(5)]
    shared = [sent(60) for _ in range(3)]
    rows = [(i, "\n".join([sent(40) for _ in range(4)])) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # copies
    rows += [(110 + i, rows[i][1].replace("\n", " ", 9) + " tail") for i in range(5)]  # same words on one line
    rows += [(200 + i, sent(60) + "\n" + shared[i % 3] + "\n" + sent(50)) for i in range(9)]  # passages
    rows += [(300 + i, sent(60) + " " + bench[i][1] + " " + sent(40)) for i in range(5)]  # leaks
    rows += [(400 + i, f"BUY!! NOW!! $$$ {i} ### %%% " * 30) for i in range(4)] + [(500, None), (501, "short")]
    return [(i, t, "en", "src", len(t or "")) for i, t in rows], bench


def test_stages_by_brute_force(spark, tmp_path):
    rows, bench = documents(random.Random(11))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        at = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append({r.doc_id: r.text for r in at.collect()})
    junk = set(range(400, 404)) | {500, 501}
    assert set(seen[0]) == {r[0] for r in rows} - junk
    assert not set(seen[1]) & set(range(100, 105)) and set(range(110, 115)) <= set(seen[1])
    passages = [rows[50 + i][1].split("\n")[1] for i in range(3)]
    for p in passages:
        assert sum(p in t for t in seen[1].values()) == 1
    assert set(range(200, 209)) <= set(seen[1])
    classes = {}
    for d in sorted(seen[1]):
        f = brute_fp(seen[1][d])
        if not any((f ^ g).bit_count() <= 4 for g in classes.values()):
            classes[d] = f
    assert set(seen[2]) == set(classes) and not set(seen[2]) & set(range(110, 115))
    assert set(seen[3]) == set(seen[2]) - set(range(300, 305))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(seen[3])
    assert sum(r.length for r in got) > 0 and {r.piece for r in got} == {0}


def test_stages_on_odd_tables(spark, tmp_path):
    """Null and repeated doc_ids, repeated rows, working columns' names, a very long text, and no rows at all."""
    rnd = random.Random(3)
    word = lambda: rnd.choice(["the ", "and ", "of "]) + "w" + str(rnd.randrange(10**6))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n))
    a, b, c, long = text(6), text(7), text(8), text(2500)
    rows = [(1, a, 5, 6, 7), (None, b, 5, 6, 7), (None, c, 5, 6, 7), (3, c + "\n" + text(9), 5, 6, 7), (3, long, 5, 6, 7), (3, long, 5, 6, 7), (4, None, 5, 6, 7), (5, "", 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _w_gone int, _w_key int, size int")
    spark.createDataFrame([(9, " ".join(a.split()[20:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table, n in ((docs, 4), (docs.limit(0), 0)):
        at = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            at = stage(spark, at, str(tmp_path))
            assert at.columns == docs.columns
            at.write.parquet(str(tmp_path / f"odd{n}-{k}"))
            at = spark.read.parquet(str(tmp_path / f"odd{n}-{k}"))
        left = at.collect()
        assert len(left) == n and all(tuple(r)[2:] == (5, 6, 7) for r in left)
        if n:
            assert {r.text for r in left} >= {b, c, long} and all(r.doc_id != 1 for r in left)
        assert corpus_pipeline.packing_stage(spark, at, str(tmp_path)).select("doc_id").distinct().count() == min(n, 2)
