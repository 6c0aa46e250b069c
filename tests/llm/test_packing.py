import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing as P


def naive(lengths, tokens, documents, attention, tile):
    """Vector best fit by trying every open sequence."""
    w, bins, out = P.WEIGHTS, [], [None] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n, cost = lengths[k], (-(-lengths[k] // tile)) ** 2
        norm = lambda t, d, a: w[0] * (t - n) * documents * attention + w[1] * (d - 1) * tokens * attention + w[2] * (a - cost) * tokens * documents  # noqa: B023, E731
        fit = [(norm(t, d, a), t, i) for i, (t, d, a) in enumerate(bins) if t >= n and d >= 1 and a >= cost]
        if not fit:
            bins.append([tokens, documents, attention])
            fit = [(0, 0, len(bins) - 1)]
        i = min(fit)[2]
        out[k] = i
        bins[i] = [bins[i][0] - n, bins[i][1] - 1, bins[i][2] - cost]
    return out


@pytest.mark.parametrize("caps", [(100, 512, 10_000, 1), (100, 3, 10_000, 1), (100, 5, 4_000, 1), (100, 1, 10_000, 1), (100, 6, 25, 20)])
def test_placement_equals_plain_vector_best_fit(caps):
    tokens, documents, attention, tile = caps
    rnd = random.Random(sum(caps))
    most = min(100, tile * int(attention**0.5))
    lengths = [min(rnd.choice([1, 2, 3, 7, 20, 33, 50, 60, rnd.randint(1, 100)]), most) for _ in range(500)]
    seq, off = P.best_fit(np.array(lengths), tokens, documents, attention, tile=tile)
    rows = defaultdict(list)
    for s, o, n in zip(seq, off, lengths, strict=True):
        rows[s].append((o, n))
    for r in rows.values():
        r.sort()
        assert [o for o, _ in r] == list(np.cumsum([0] + [n for _, n in r])[:-1])
        assert sum(n for _, n in r) <= tokens and len(r) <= documents and sum((-(-n // tile)) ** 2 for _, n in r) <= attention
    assert seq.tolist() == naive(lengths, *caps)


def test_every_capacity_binds():
    """With the production parameters each of the three limits closes some sequence."""
    full = lambda lengths: np.bincount(P.best_fit(np.array(lengths))[0])
    assert max(full([2] * 500)) == P.DOCUMENTS  # documents
    assert max(full([130] * 40)) == 7 and max(full([512] * 9)) == 2  # tokens
    assert max(full([260] * 3 + [3] * 200)) <= P.DOCUMENTS
    mixed = P.best_fit(np.array([640] + [20] * 45))[0]  # 660 to 1024 tokens would hold 18 more of 20; 25 + 39 tiles hold 39
    assert np.bincount(mixed).max() <= P.DOCUMENTS
    tiles = P.best_fit(np.array([770] + [5] * 47))[0]  # 49 tiles, so 23 more documents, though tokens and documents have room
    assert np.bincount(tiles)[tiles[0]] == 24
    long = P.best_fit(np.array([1000] + [3] * 20))[0]  # 64 tiles leave room for 8 documents beside the longest pieces
    assert np.bincount(long)[long[0]] == 9


def test_query_round_trip(spark, tmp_path):
    rnd = random.Random(2)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", " ", "a<|endoftext|>b", "Ünï \n\n cödé's  text\t!", "x" * 5000] + [" ".join(rnd.choice(["the", "räre", "of\n", " token", "9 9"]) for _ in range(rnd.randint(1, 4000))) for _ in range(40)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(3, texts[3], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op9_packing(spark, str(tmp_path)).collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    want = []
    for i, _, _ in rows:
        n = len(ids[i])
        first = n if n <= 1024 else n % 1024 or 1024
        starts = [0, *range(first, n, 1024)]
        for k, s in enumerate(starts):
            part = ids[i][s : first if k == 0 else s + 1024]
            want.append((i, k, s, len(part), crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == list(np.cumsum([0] + [n for _, n in b])[:-1]) and sum(n for _, n in b) <= 1024
    assert len(bins) <= -(-sum(len(ids[i]) for i, _, _ in rows) // 1024) + 2
    seqs = P.sequences(docs).collect()
    assert sum(len(r.ids) // 4 for r in seqs) == sum(len(ids[i]) for i, _, _ in rows)
    assert P.pack(P.pieces(docs.limit(0))).count() == 0
    odd = P.pieces(docs).withColumns({"_w_g": F.lit(7), "offset": F.lit("x"), "__in_w_g": F.lit(8)})
    out = P.pack(odd)
    assert out.columns == [*[c for c in odd.columns if c != "offset"], "sequence_id", "offset"] and {(r._w_g, r["__in_w_g"]) for r in out.collect()} == {(7, 8)}
