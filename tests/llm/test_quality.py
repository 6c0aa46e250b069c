import re
from collections import Counter

from tidemark.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": len(w) < 50 or 100 * len(hit) > 50 * len(w),
    }


GOOD = " ".join(f"wörd{i} some text{i}." for i in range(60))
CASES = [None, "", " \t\n\x0b", "a b c a b c a b c", "x\n x\nx\n\n\n" * 3, "# * $ % & | < > ## é😀", GOOD, "one two three " * 40, "a a a a", GOOD + "\n" + GOOD, "w " * 20000]


def test_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(CASES)], "doc_id long, text string, _w_w int")
    got = {r.doc_id: r for r in Q.judge(docs).collect()}
    for i, t in enumerate(CASES):
        for k, v in brute(t).items():
            assert got[i][k] == v, (i, k)
    assert got[6].kept and not got[7].kept


def test_keep_good_agrees_with_judge_and_keeps_columns(spark):
    rows = [(i, GOOD + f" tail{i}.", i) for i in range(40)] + [(100 + i, f"BUY!! NOW!! {i} $$$ ### %%% " * 15, i) for i in range(10)] + [(None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _w_n_words int")
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    assert sorted(r.doc_id for r in Q.judge(docs).where("kept").collect()) == list(range(40))
    empty = spark.createDataFrame([], docs.schema)
    assert Q.judge(empty).count() == 0 and Q.keep_good(empty).count() == 0


def test_em_finds_accuracies():
    pats = [((1, 1, 1), 700), ((-1, -1, -1), 200), ((1, 1, -1), 60), ((-1, -1, 1), 20), ((0, 1, 1), 50)]
    share, rel = Q.fit_rules(pats)
    assert 0.7 < share < 0.85 and rel[0][1, 1] > 0.85 and rel[2][0, -1] > 0.7
    assert Q.posterior((1, 1, -1), share, rel) > 0.9 > 0.1 > Q.posterior((-1, -1, 1), share, rel)


def test_votes_against_labels(spark):
    """The votes find the bad documents that pass the base rule, and leave good ones alone. Labels are only read here."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op6_quality(spark, sf).collect()}
    rows = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    passed = [(q, r) for q, r in rows if not r.base_failed]
    bad, good = [r for q, r in passed if not q], [r for q, r in passed if q]
    caught, lost = sum(not r.kept for r in bad), sum(not r.kept for r in good)
    assert len(bad) >= 20 and caught >= 0.9 * len(bad), (caught, len(bad))
    assert lost <= 0.02 * len(good), (lost, len(good))
    assert caught >= 0.9 * (caught + lost)
