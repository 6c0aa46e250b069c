"""Best-fit packing of tokenized documents under several capacities.

Documents become pieces of at most ``TOKENS`` ids; pieces are packed into sequences with
three capacities: tokens, documents, and attention cost. A block-diagonal attention kernel works in square tiles of ``TILE`` tokens and
fills those it touches, so a document of n tokens costs ceil(n / TILE)^2 of them; a sequence may cost one full piece and ``BESIDE`` tiles, so short documents can fill up what the longest pieces leave. Many short documents meet this limit or that of documents long
before the tokens are used up. Vector best fit,
longest pieces first: of the open sequences that can take the piece in every dimension, the one with the
smallest weighted residual norm is chosen (ties: the fuller one, then the one opened first). Norms are whole numbers, so equal ones are equal.

Pieces are dealt evenly into groups of about ``GROUP`` and every group is packed by itself: a
group leaves at most a few sequences unfilled, well under a thousandth, and no task grows with the
input. Only (key, length) is shuffled, never the ids.

Ids are those of the ``tokenizers`` library with ``VOCABULARY``. A text without strings of special tokens has the same ids in
``tiktoken`` with the same vocabulary as ranks, in a quarter of the time, so only the others are encoded by ``tokenizers`` itself.

Defined results: null text is empty text; every document ends with ``END_ID``, so empty ones have one token; strings of special
tokens in a text are their ids; very long documents are cut, the shorter piece first; repeated rows give
repeated pieces; an empty table gives no rows; other columns are ignored by ``pieces`` and kept by ``pack``, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import aside, stored

TOKENS = 1024
DOCUMENTS = 48
TILE = 128
#: Tiles beside a full piece.
BESIDE = 8
ATTENTION = (TOKENS // TILE) ** 2 + BESIDE
#: Weights of the residuals of tokens, documents and attention cost, in twentieths.
WEIGHTS = (20, 1, 1)
END_ID = 2
GROUP = 20_000
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

_encoders: dict[tuple[str, str], object] = {}


def encoder(vocabulary: str = VOCABULARY, ranks: str = RANKS) -> Callable[[str], list[int]]:
    """Encodes a text to the ids that ``tokenizers`` gives; one per worker."""
    if (vocabulary, ranks) not in _encoders:
        import base64
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        special = re.compile("|".join(re.escape(t.content) for t in full.get_added_tokens_decoder().values()))
        with open(public_tokenizers.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        _encoders[vocabulary, ranks] = lambda text: full.encode(text, add_special_tokens=False).ids if special.search(text) else plain(text)
    return _encoders[vocabulary, ranks]


def cuts(n: int, size: int = TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full pieces, the first takes the rest."""
    first = n % size or size
    return [(0, min(first, n)), *((s, size) for s in range(first, n, size))] if n else []


def pieces(documents: DataFrame, size: int = TOKENS, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row; ids are little-endian unsigned 32-bit."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else "")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        encode = encoder()
        for batch in batches:
            rows: list[tuple] = []
            gc.disable()  # lists of ids hold no cycles; walking them costs a fifth of the time
            try:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = encode(text.as_py() or "")
                    ids.append(END_ID)
                    raw = memoryview(np.array(ids, "<u4").tobytes())
                    for k, (start, n) in enumerate(cuts(len(ids), size)):
                        part = raw[4 * start : 4 * (start + n)]
                        rows.append((doc_id, k, start, n, crc32(part)) + ((bytes(part),) if keep_ids else ()))
            finally:
                gc.enable()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    return documents.select("doc_id", "text").mapInArrow(cut, schema)


def cost_of(n, tile: int = TILE):
    """Tiles that attention within a document of n tokens fills."""
    return (-(-n // tile)) ** 2


def best_fit(lengths: np.ndarray, tokens: int = TOKENS, documents: int = DOCUMENTS, attention: int = ATTENTION, weights=WEIGHTS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece.

    Open sequences stand in one heap per residual of tokens, by their other weighted residuals; the norm
    of the residual vector after placement differs from that sum by the same amount for all, so the best
    sequence is the least over the heaps' tops.
    """
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    none = np.iinfo(np.int64).max // 4
    heaps: list[list] = [[] for _ in range(tokens + 1)]
    top = np.full(tokens + 1, none)
    # residuals over capacities, times all capacities
    level = weights[0] * documents * attention * np.arange(tokens + 1)
    rest = lambda d, a: weights[1] * tokens * attention * d + weights[2] * tokens * documents * a
    opened = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        cost = cost_of(n, tile)
        if n > tokens or cost > attention or documents < 1:
            raise ValueError("a piece exceeds the capacity of an empty sequence")
        score = level[n:] + top[n:]
        aside, chosen = [], None
        while True:
            at = int(np.argmin(score))
            if score[at] >= none:
                break
            at += n
            heap = heaps[at]
            while heap and (heap[0][2] < 1 or heap[0][3] < cost):  # no room in another dimension
                aside.append((at, heapq.heappop(heap)))
            top[at] = heap[0][0] if heap else none
            if heap and top[at] + level[at] <= score[at - n]:
                chosen = at, heapq.heappop(heap)
                top[at] = heap[0][0] if heap else none
                break
            score[at - n] = top[at] + level[at]
        for at, entry in aside:
            heapq.heappush(heaps[at], entry)
            top[at] = heaps[at][0][0]
        if chosen is None:
            left, (_, s, d, a) = tokens, (0, opened, documents, attention)
            opened += 1
        else:
            left, (_, s, d, a) = chosen
        seq[k], offset[k] = s, tokens - left
        left, d, a = left - n, d - 1, a - cost
        if left > 0 and d > 0 and a > 0:
            heapq.heappush(heaps[left], (rest(d, a), s, d, a))
            top[left] = heaps[left][0][0]
    return seq, offset


def pack(cut: DataFrame, group: int = GROUP, **capacities) -> DataFrame:
    """Add (sequence_id, offset) to pieces (any columns besides ``length``; the caller's columns of those names are replaced)."""
    held = stored(aside(cut.drop("sequence_id", "offset")), "pieces")
    groups = max(1, -(-held.count() // group))
    dealt = held.withColumn("_w_g", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        s, o = best_fit(frame["length"].to_numpy(), **capacities)
        frame = frame.assign(sequence_id=s + (frame["_w_g"].iloc[0] << 32), offset=o)
        return frame.drop(columns="_w_g")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    out = dealt.groupBy("_w_g").applyInPandas(fill, f"{fields}, sequence_id bigint, offset bigint")
    return out.select(*[F.col(f"`{h}`").alias(c) for h, c in zip(held.columns, [c for c in cut.columns if c not in ("sequence_id", "offset")], strict=True)], "sequence_id", "offset")


def sequences(documents: DataFrame, **capacities) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids, lengths), ids concatenated in place order. One sequence holds at most ``TOKENS`` ids."""
    packed = pack(pieces(documents, keep_ids=True), **capacities)
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    gathered = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return gathered.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"), F.transform("p", lambda p: p["length"]).alias("lengths"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    out = pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
