import random

import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import tokens as T

PATH = public_tokenizers.path(T.MODEL)
BITS = [" ", "  ", "\n", "▁", "a", "e", "é", "日", "\t", "x", "0", "<s>", ">", "in", "er", "the", "ﬁ", "😀", "\x00", "́", " t", "ing", "0x41", "ab", "==", "Ж", "не", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def machine():
    return T.Transducer(T.vocabulary(PATH))


def made(n, most, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_counts_are_the_librarys(machine, library):
    for text in [*made(3000, 30), *(c * n for c in ("a", " ", "=", "0", " a", "aab", "日本") for n in (1, 63, 64, 500))]:
        assert machine.count(text) == len(library.encode(text)), repr(text)


def test_chunk_maps_compose(machine, library):
    for k, text in enumerate([*made(150, 80, 2), "a" * 300, "ab" * 100, " " * 90]):
        read, size = T.escaped(text), 1 + k % 9
        maps = [machine.mapped(read[i : i + size]) for i in range(0, len(read), size)]
        every = machine.scan(maps)
        assert machine.closed(every[-1]) == machine.run(read) and len(every) == len(maps)
        at = k % len(maps)
        assert machine.closed(every[at]) == machine.run(read[: (at + 1) * size])
        left = maps[0]
        for m in maps[1:]:
            left = machine.compose(left, m)
        assert machine.closed(left) == machine.closed(every[-1])


def test_tables_may_be_emptied(library, monkeypatch):
    monkeypatch.setattr(T, "STATES", 40)
    monkeypatch.setattr(T, "WORDS", 5)
    small = T.Transducer(T.vocabulary(PATH))
    for text in made(60, 30, 3):
        assert small.count(text) == len(library.encode(text))


def test_long_texts_are_dealt_out(spark, library):
    texts = [None, "", "short", *made(12, 60, 4), "a" * 500, "many words " * 80, "many words " * 80]
    docs = spark.createDataFrame([(i, t, i % 2, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, _w_tokens string")
    got = {r.doc_id: r for r in T.with_counts(docs, PATH, long=40, chunk=7).collect()}
    assert {i: r._w_tokens for i, r in got.items()} == {i: len(library.encode(t or "")) for i, t in enumerate(texts)}
    out = T.token_counts(docs, PATH, limit=100)
    assert out.columns == ["doc_id", "text", "_w_tokens", "n_bytes", "n_tokens", "over_limit"]
    for r in out.collect():
        want = len(library.encode(r.text or ""))
        assert (r.n_tokens, r.over_limit, r.n_bytes, r._w_tokens) == (want, want > 100, len((r.text or "").encode()), "x")
    assert T.token_counts(docs.limit(0), PATH).count() == 0
    again = T.token_counts(docs.unionByName(docs), PATH)
    assert again.count() == 2 * len(texts)


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096) for r in docs)
    assert sorted(map(tuple, T.op12_tokens(spark, "/root/testdata/sf0.001").collect())) == want
