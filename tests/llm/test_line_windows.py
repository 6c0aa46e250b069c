import random
import zlib

from tidemark.llm import lines as L


def all_runs(docs):
    """Lines of every run of MIN_WORDS words that an earlier place holds too, by comparing all places. docs: {id: text} in order."""
    seen = [(k, *L.line_hashes(t)) for k, t in sorted(docs.items())]
    gone = {}
    for x, (d, h, c) in enumerate(seen):
        for y, (_, s, _) in enumerate(seen[: x + 1]):
            for i in range(len(h)):
                for j in range(len(s) if y < x else i):
                    if h[i] == s[j] and not (i and j and h[i - 1] == s[j - 1]):
                        b = 0
                        while i + b < len(h) and j + b < len(s) and h[i + b] == s[j + b]:
                            b += 1
                        if sum(c[i : i + b]) >= L.MIN_WORDS:
                            gone.setdefault(d, set()).update(range(i, i + b))
    return {d: sorted(v) for d, v in gone.items()}


def test_first_holder_has_only_a_part(spark):
    rnd = random.Random(2)
    line = lambda n: " ".join(f"w{rnd.randrange(99999)}" for _ in range(n))
    docs, at = {}, 0
    for _ in range(20):  # whichever line has the least hash
        run, other, tail = line(30), line(30), [line(60), line(8)]
        for text in ([run, line(30)], [run, other], [run, other], [line(30), other], tail[:1], tail, [line(9), *tail]):
            docs[at] = "\n".join(text)
            at += 1
    pool = [line(rnd.choice([5, 12, 20, 26, 55])) for _ in range(12)]
    for _ in range(60):
        docs[at] = "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 7)))
        at += 1
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: list(r.lines) for r in L.repeated_lines(frame).collect()}
    assert got == all_runs(docs)
    assert got[2] == [0, 1] and got[6] == [1, 2]


def test_minima_are_the_leftmost_least_lines():
    rnd = random.Random(5)
    for _ in range(100):
        n = rnd.randint(0, 70)
        h, c = [rnd.randint(-4, 4) for _ in range(n)], [rnd.choice([1, 1, 3, 20, 60]) for _ in range(n)]
        _, start, end = L.windows(h, c)
        assert L.minima(h, start, end).tolist() == [min(range(a, b), key=lambda i: (h[i], i)) for a, b in zip(start, end, strict=True)]


def test_query_equals_all_pairs(spark, tmp_path):
    rnd = random.Random(12)
    line = lambda n: " ".join(f"w{rnd.randrange(99999)}" for _ in range(n))
    pool = [line(rnd.choice([1, 4, 9, 20, 30, 60])) for _ in range(25)]
    docs = {i: "\n".join(rnd.choice([rnd.choice(pool), rnd.choice(pool), line(7), ""]) for _ in range(rnd.randint(1, 14))) for i in range(60)}
    for i in range(60, 75):  # whole passages between lines of their own
        at = rnd.randrange(12)
        docs[i] = "\n".join([line(3), *pool[at : at + rnd.randint(2, 12)], line(3)])
    docs |= {80: "", 81: "\n \n", 82: docs[70], 83: "\n".join([pool[3]] * 200)}
    spark.createDataFrame([*docs.items(), (90, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = all_runs(docs)
    got = {r.doc_id: r for r in L.op10_lines(spark, str(tmp_path)).collect()}
    assert set(got) == {*docs, 90} and len(want) > 20
    for d, t in (docs | {90: ""}).items():
        gone = want.get(d, [])
        assert list(got[d].deleted_lines) == gone and got[d].n_deleted_lines == len(gone)
        if not gone:
            assert got[d].kept_crc32 == zlib.crc32(t.encode())
    assert got[82].n_deleted_lines == len(docs[82].split("\n")) and got[82].kept_crc32 == 0
    lone = [i for i in range(60, 75) if want.get(i) and want[i] == list(range(1, len(docs[i].split("\n")) - 1))]
    assert lone
    for i in lone:  # only the first and the last line stay
        first, *_, last = docs[i].split("\n")
        assert got[i].kept_crc32 == zlib.crc32(f"{first}\n{last}".encode())
