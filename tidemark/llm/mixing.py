"""Language-model scoring by online logistic context mixing.

A text is the sequence of its lower-cased words and one end. Every word is coded by bits: from the longest context down, one bit says
whether the word was seen in it (after the word before, after the last letters of the word before, anywhere, earlier in this text); the first
yes gives the word by its share of the context's count. A word never seen is spelled by the bits of its bytes (five of each frequent one, see ``SYMBOL``) and a terminator. Each bit is predicted by several hashed-context
predictors; gated weights mix their stretched probabilities and a table over (gate, mixed probability) refines the result. Weights, predictors and
refinement learn online over the whole training stream: each bit is predicted first and learned then. The total is in log10; bits per byte follow from it.

A training text is scored, and trained on, by the counts of the other training texts, so its bits look like those of held-out text
and scores of both are comparable; a text that stands twice in the corpus is told apart by its copy.

Where the work is done:

* Texts are dealt to streams by the hash of id and text, as many as their bytes ask for, and lie in each in the order of that hash. Streams become segments (the
  distinct words, and every token's word), stored in the shared folder: which texts meet in a segment depends on the rows alone, not on files or tasks.
* Context counts (see ``ORDERS``) are exact and grow with the corpus: every segment sends its distinct hashed contexts, cut by hash range into parts; a part sums them
  and answers each segment. A common context counts once a segment. Words are told by 64 bits, longer contexts by 32 bits and the part.
* Every segment trains a mixer from the start; predictor tables, weights and refinement (by the bits that each gate or cell saw) are vectors of fixed size in whole
  numbers, summed by the tasks and then in Spark slice by slice before the driver reads one such vector. Sums of whole numbers don't depend on the order, so neither do scores.
* Segments are scored with that vector, one row a document.

Defined results: null text is empty text, which has one token, the end; null doc_id counts as the empty string for the
hold-out rule; no training text gives base score log10(1/1) a token and an untrained model; texts are read whole;
repeated rows get equal results, as nothing crosses the start of a text, and meet in one stream, whose segments are cut by tokens like any other's; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, freed, row_key, stored

#: Bytes of text of a stream on average, and tokens at which its segments are cut.
STREAM_BYTES, SEGMENT_TOKENS = 1 << 22, 1_000_000
#: Distinct contexts of a part on average.
PART_KEYS = 3_000_000
#: Contexts that are counted: word; word before and word; last letters before and word; last letters before.
ORDERS = ("w", "pw", "sw", "s")
SUFFIX = 3
#: Levels from the longest context down; the last is the text itself (words that no other text has), then spelling.
LEVELS = ("pw", "sw", "w", "own")
#: Slots of the spelling predictors: one byte before, three bytes before, word so far. Letters need no more however large the corpus.
SIZES = (1 << 16, 1 << 19, 1 << 20)
#: Slots of each of the level predictors.
LEVEL_SLOTS, LEVEL_INPUTS = 1 << 14, 3
LEVEL_GATES, SPELL_GATES = len(LEVELS) * 16, 64
STEPS = 33
SLICE = 1 << 16
#: What is learned is summed in units of one part in so many.
UNIT = 1 << 12
DELTA = 0.4
START = np.uint64(0x2545F4914F6CDD1D)
#: Bits that are predicted before they are learned.
BATCH, WORDS = 1 << 15, 2048

SEGMENT = "seg bigint, doc_ids array<bigint>, held array<boolean>, sizes array<bigint>, ends array<bigint>, words binary, code binary"


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _full(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def _planes(code: np.ndarray) -> bytes:
    """Compressed word numbers: lower two bytes, then the upper ones, which are mostly zero."""
    whole = code.astype("<i4").view("<u2")
    return _squeezed(whole[::2].tobytes() + whole[1::2].tobytes())


def _code(blob: bytes) -> np.ndarray:
    halves = np.frombuffer(_full(blob), "<u2").reshape(2, -1).astype(np.int32)
    return halves[0] | halves[1] << 16


def segments(documents: DataFrame) -> DataFrame:
    """Segments (see ``SEGMENT``) of whole texts, by stream. The end token is the empty word."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = number = None

        def fresh() -> tuple:
            lookup = defaultdict(int, {b"": 0})
            lookup.default_factory = lookup.__len__  # a new word gets the next number
            return [], [], [], [], lookup, [], 0

        def made() -> pa.RecordBatch:
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            cols = [pa.array([number], pa.int64()), one(ids, pa.int64()), one(held, pa.bool_()), one(sizes, pa.int64()), one(ends, pa.int64()), pa.array([_squeezed(b" ".join(lookup))], pa.binary()), pa.array([_planes(np.concatenate(codes))], pa.binary())]
            return pa.record_batch(cols, names=[f.split()[0] for f in SEGMENT.split(", ")])

        ids, held, sizes, ends, lookup, codes, n = fresh()
        for batch in batches:
            for doc_id, out, raw, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).to_pylist(), strict=True):
                raw = raw.as_py() or b""
                w = raw.lower().split()
                w.append(b"")
                if n and (of != stream or n + len(w) > SEGMENT_TOKENS):
                    yield made()
                    number += 1
                    ids, held, sizes, ends, lookup, codes, n = fresh()
                if of != stream:
                    stream, number = of, of << 24
                codes.append(np.fromiter(map(lookup.__getitem__, w), np.int32, len(w)))
                n += len(w)
                ids.append(doc_id)
                held.append(out)
                sizes.append(len(raw))
                ends.append(n)
        if ids:
            yield made()

    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 7 == 2
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    stream = F.pmod(row_key(), F.lit(max(1, -(-size // STREAM_BYTES))))
    dealt = documents.select("doc_id", held.alias("held"), "text", stream.alias("stream"), row_key().alias("row")).repartition("stream")
    return dealt.sortWithinPartitions("stream", "row", "doc_id").drop("row").mapInArrow(build, SEGMENT)


def mixed_hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def after(x: np.ndarray, start: np.ndarray, first) -> np.ndarray:
    """What stands one token before; ``first`` at the starts of texts."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[start] = first
    return out


class Segment:
    """A segment's tokens and their hashed contexts."""

    def __init__(self, row: dict):
        import xxhash

        self.words = _full(row["words"]).split(b" ")
        self.code = _code(row["code"])
        self.ends = np.asarray(row["ends"], np.int64)
        self.start = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.ends)), self.ends - self.start)
        self.held = np.asarray(row["held"], bool)
        self.train = ~self.held[self.doc]
        digest, tails = xxhash.xxh64_intdigest, {}
        self.hash = np.fromiter(map(digest, self.words), np.uint64, len(self.words))
        tail = np.fromiter((tails.setdefault(w[-SUFFIX:], len(tails)) for w in self.words), np.int64, len(self.words))
        self.tails = np.array([*(digest(t, 1) for t in tails), int(START)], np.uint64)
        self.tail = after(tail[self.code], self.start, len(tails))

    def keys(self, order: str) -> np.ndarray:
        """Hashed context of every token, for the orders of more than one word."""
        h = self.hash[self.code]
        if order == "sw":
            return mixed_hash(self.tails[self.tail] * np.uint64(0xD6E8FEB86659FD93) + h)
        return mixed_hash(after(h, self.start, START) * np.uint64(0xBF58476D1CE4E5B9) + h)

    def distinct(self, order: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys, and each token's place among them."""
        if order not in ("w", "s"):
            return np.unique(self.keys(order), return_inverse=True)
        few, at = (self.hash, self.code) if order == "w" else (mixed_hash(self.tails), self.tail)
        key, rank = np.unique(few, return_inverse=True)
        return key, rank[at]

    def own(self, at: np.ndarray, every: np.ndarray) -> np.ndarray:
        """How often each token's key stands in its own training text; 0 in held-out texts. What the corpus has once needs no search."""
        out = self.train.astype(np.int32)
        several = np.flatnonzero(self.train & (every > 1))
        _, which, times = np.unique(self.doc[several] * (int(at.max(initial=0)) + 1) + at[several], return_inverse=True, return_counts=True)
        out[several] = times[which]
        return out


ASKED = "ord int, part bigint, seg bigint, keys binary, n binary"
ANSWER = "ord int, part bigint, seg bigint, n binary, known bigint"


def _pack(x: np.ndarray) -> bytes:
    return _squeezed(x.astype("<u4").tobytes())


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(_full(x), "<u4").astype(np.int64)


def _shrunk(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as their differences, three bytes each if these are small."""
    gaps = np.diff(keys, prepend=keys.dtype.type(0)).astype("<u4")
    return gaps.tobytes() if len(gaps) and gaps.max() >> 24 else gaps.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _grown(blob: bytes, n: int) -> np.ndarray:
    if len(blob) == 4 * n:
        return np.cumsum(np.frombuffer(blob, "<u4"), dtype=np.uint32)
    gaps = np.zeros((n, 4), np.uint8)
    gaps[:, :3] = np.frombuffer(blob, np.uint8).reshape(-1, 3)
    return np.cumsum(gaps.view("<u4")[:, 0], dtype=np.uint32)


def ask(held: DataFrame, bits: int) -> DataFrame:
    """Each segment's distinct contexts and training counts, cut by the upper ``bits`` of the hash (see ``ASKED``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                seg = Segment(row)
                for order, name in enumerate(ORDERS):
                    key, at = seg.distinct(name)
                    n = np.bincount(at[seg.train], minlength=len(key))
                    part = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
                    sub = key if name == "w" else (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    names, begin = np.unique(part, return_index=True)
                    spans = list(zip(begin.tolist(), [*begin[1:].tolist(), len(key)], strict=True))
                    cols = [pa.array([order] * len(names), pa.int32()), pa.array(names), pa.array([row["seg"]] * len(names), pa.int64()), pa.array([sub[a:b].tobytes() if name == "w" else _shrunk(sub[a:b]) for a, b in spans], pa.binary()), pa.array([_pack(n[a:b]) for a, b in spans], pa.binary())]
                    yield pa.record_batch(cols, names=["ord", "part", "seg", "keys", "n"])

    return held.mapInArrow(cut, ASKED)


def answers(asked: DataFrame) -> DataFrame:
    """Corpus counts of the contexts asked for, in the order asked (see ``ANSWER``); known: distinct contexts of the part with a count, on one of its rows."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        counts = [_unpack(n) for n in part["n"]]
        whole = ORDERS[part["ord"].iloc[0]] == "w"
        blobs = [np.frombuffer(k, np.uint64) if whole else _grown(k, len(n)) for k, n in zip(part["keys"], counts, strict=True)]
        _, at = np.unique(np.concatenate(blobs), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        out, upto = [], 0
        for b in blobs:
            out.append(_pack(total[at[upto : upto + len(b)]]))
            upto += len(b)
        known = np.zeros(len(part), np.int64)
        known[0] = np.count_nonzero(total)
        return pd.DataFrame({"ord": part["ord"], "part": part["part"], "seg": part["seg"], "n": out, "known": known})

    return asked.groupBy("ord", "part").applyInPandas(add, ANSWER)


COUNTED = SEGMENT + ", " + ", ".join(f"c_{o} binary" for o in ORDERS)


def counted(held: DataFrame, told: DataFrame) -> DataFrame:
    """Segments with the corpus counts of their distinct contexts, sorted by key (see ``COUNTED``)."""
    per = told.groupBy("seg").agg(F.collect_list(F.struct("ord", "part", "n")).alias("a")).withColumnRenamed("seg", "of")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in COUNTED.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                a = batch.column(batch.schema.get_field_index("a"))[i].as_py()
                cols = [batch.column(k).slice(i, 1) for k in range(len(SEGMENT.split(", ")))]
                for order in range(len(ORDERS)):
                    mine = sorted((x["part"], x["n"]) for x in a if x["ord"] == order)
                    cols.append(pa.array([_pack(np.concatenate([_unpack(n) for _, n in mine]))], pa.binary()))
                yield pa.record_batch(cols, names=names)

    return held.join(per, held["seg"] == per["of"]).drop("of").mapInArrow(put, COUNTED)


def _log2(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(x, 0).astype(np.float32) + np.float32(1)), 15).astype(np.int64)


class Tokens:
    """Every token's counts in the other texts: of each level's context, and of the word in it."""

    def __init__(self, seg: Segment, row: dict, tokens: int, texts: int):
        n = len(seg.code)
        self.seg, self.seen, self.context = seg, {}, {}
        for o in ORDERS:
            _, at = seg.distinct(o)
            every = _unpack(row[f"c_{o}"]).astype(np.int32)[at]
            if o == "w":
                self.plain = every
            self.seen[o] = every - seg.own(at, every)
        first = np.zeros(n, bool)
        first[seg.start] = True
        c = self.context
        c["w"] = tokens - np.where(seg.train, (seg.ends - seg.start)[seg.doc], 0)
        c["pw"] = np.where(first, texts - seg.train, after(self.seen["w"], seg.start, 0))
        c["sw"] = self.seen.pop("s")
        # words that no other text has: told by the text's own earlier ones
        self.new = self.seen["w"] <= 0
        at = np.flatnonzero(self.new)
        _, which = np.unique(seg.doc[at] * len(seg.words) + seg.code[at], return_inverse=True)
        order = np.argsort(which, kind="stable")
        run = which[order]
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], run[1:] != run[:-1]])[: len(run)], np.arange(len(run)), 0))
        self.seen["own"] = np.zeros(n, np.int32)
        self.seen["own"][at[order]] = np.arange(len(run)) - begin
        upto = np.cumsum(self.new) - self.new
        c["own"] = upto - upto[seg.start][seg.doc]

    def chunks(self, size: int = 50_000) -> Iterator[Levels]:
        """Levels of whole texts, about ``size`` tokens at a time (a longer text by itself)."""
        ends, a = self.seg.ends, 0
        while a < len(self.seg.code):
            b = int(ends[min(np.searchsorted(ends, a + size), len(ends) - 1)])
            yield Levels(self, a, b)
            a = b


class Levels:
    """The level bits of the tokens a to b, in stream order, with their predictor slots."""

    def __init__(self, tokens: Tokens, a: int, b: int):
        seg, n = tokens.seg, b - a
        self.seg, self.a, self.b = seg, a, b
        start = seg.start[(seg.start >= a) & (seg.start < b)] - a
        c = np.stack([tokens.context[o][a:b] for o in LEVELS], 1)
        s = np.stack([tokens.seen[o][a:b] for o in LEVELS], 1)
        np.minimum(s, c, out=s, casting="unsafe")
        yes = s > 0
        #: The level that gives the word, len(LEVELS) for spelling.
        self.level = np.where(yes.any(1), yes.argmax(1), len(LEVELS))
        # a bit for every level with a context, down to the one that gives the word
        token, level = np.nonzero((c > 0) & (np.arange(len(LEVELS)) <= self.level[:, None]))
        self.token, self.of, self.bit = token, level, (level == self.level[token]).astype(np.int64)
        pick = (np.arange(n), np.minimum(self.level, len(LEVELS) - 1))
        self.share = np.where(self.level < len(LEVELS), np.log10(np.maximum(s[pick], 1) / np.maximum(c[pick], 1)), 0.0)
        size = _log2(c)
        last = after(self.level, start, 0)
        third = after(last, start, 0)
        history = (last * 6 + third) * 6 + after(third, start, 0)  # the last three outcomes, of five each
        own = size[token, level]
        self.gate = level * 16 + own
        lower = size[token, np.minimum(level + 1, len(LEVELS) - 1)]
        base = [
            (self.gate * 16 + lower).astype(np.uint64),
            ((history[token] * 16 + own) * 8 + level).astype(np.uint64),
            seg.tails[seg.tail[a:b]][token] * np.uint64(128) + self.gate.astype(np.uint64),
        ]
        self.slots = [(mixed_hash(x + np.uint64(17 * k)) & np.uint64(LEVEL_SLOTS - 1)).astype(np.int64) + k * LEVEL_SLOTS for k, x in enumerate(base)]
        #: First occurrences, in each text, of words to spell.
        self.spelled = np.flatnonzero(self.level == len(LEVELS))

    def to_spell(self, at: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Words, and the last letters of the words before."""
        seg, first = self.seg, set(self.seg.start.tolist())
        code, at = seg.code, (at + self.a).tolist()
        return [seg.words[code[k]] for k in at], [b"" if k in first else seg.words[code[k - 1]][-SUFFIX:] for k in at]


def flat(words: list[bytes], tails: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of tail, a blank, word and terminator; each byte's word; and its place in the word (negative in the tail)."""
    joined = [t.rjust(SUFFIX) + b" " + w + b" " for t, w in zip(tails, words, strict=True)]
    size = np.fromiter(map(len, joined), np.int64, len(joined))
    data = np.frombuffer(b"".join(joined), np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(words)), size)
    return data, word, np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size) - SUFFIX - 1


def contexts(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of the bytes to code, and per predictor a hash of what comes before: bytes reach into the word before, the word so far doesn't."""
    at = np.flatnonzero(place >= 0)
    one = data[at - 1]
    triples = one | data[at - 2] << 8 | data[at - 3] << 16
    power = np.multiply.accumulate(np.full(int(place.max(initial=0)) + 1, 0xD6E8FEB86659FD93, np.uint64))
    total = np.cumsum(np.where(place >= 0, (data + 1).astype(np.uint64) * power[np.maximum(place, 0)], np.uint64(0)), dtype=np.uint64)
    prior = np.concatenate([np.zeros(1, np.uint64), total])[:-1]
    begin = at - place[at]
    so_far = prior[at] - prior[begin]
    return at, [one.astype(np.uint64), mixed_hash(triples.astype(np.uint64) + np.uint64(7)), mixed_hash(so_far + np.uint64(13))]


FIRST = tuple(int(x) for x in np.concatenate([[0], np.cumsum(SIZES)[:-1]]))


#: A byte's first five bits tell frequent ones apart: letters, the terminator, three signs and the first byte of Latin letters with accents; the last code is any other byte, whose own eight bits follow.
FREQUENT = b"abcdefghijklmnopqrstuvwxyz .,-\xc3"
SYMBOL = np.full(256, len(FREQUENT), np.int64)
SYMBOL[list(FREQUENT)] = np.arange(len(FREQUENT))


def spell_bits(words: list[bytes], tails: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(word, bit, slots) of every bit. A context has a block of 32 slots for the first five bits, so these lie together."""
    data, word, place = flat(words, tails)
    at, ctx = contexts(data, place)
    byte, word = data[at], word[at]
    base = [FIRST[k] + 32 * (mixed_hash(c + np.uint64(k)) & np.uint64(SIZES[k] // 32 - 1)).astype(np.int64) for k, c in enumerate(ctx)]
    symbol = SYMBOL[byte]
    for k in range(5):
        node = (symbol | 32) >> (5 - k)
        yield word, (symbol >> (4 - k)) & 1, [b + node for b in base]
    rare = np.flatnonzero(symbol == len(FREQUENT))
    byte, word, ctx = byte[rare], word[rare], [c[rare] for c in ctx]
    for k in range(8 if len(rare) else 0):
        node = ((byte | 256) >> (8 - k)).astype(np.uint64)
        yield word, (byte >> (7 - k)) & 1, [FIRST[j] + (mixed_hash(c + node * np.uint64(0xBF58476D1CE4E5B9)) & np.uint64(SIZES[j] - 1)).astype(np.int64) for j, c in enumerate(ctx)]


class Mixer:
    """Predictor tables, gated weights and refinement of one kind of bits."""

    def __init__(self, slots: int, inputs: int, gates: int):
        self.inputs, self.gates = inputs, gates
        self.counts = np.zeros((slots, 2), np.float32)
        self.weights = np.full((gates, inputs), 1.2 / inputs, np.float32)
        self.refine = np.tile(1 / (1 + np.exp(-(np.arange(STEPS) - STEPS // 2) / 2.0)), (gates, 1)).astype(np.float32)
        self.seen = 0.0
        #: Bits that each gate and each cell of the refinement has learned from, and one.
        self.hits, self.cells = np.ones((gates, 1)), np.ones((gates, STEPS))

    def inputs_of(self, slots: list[np.ndarray], bit: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Stretched probabilities, and how often each slot was seen. ``own`` marks bits that the counts have learned from this very text: they are taken out."""
        stretch, seen = np.empty((len(slots), len(slots[0])), np.float32).T, []
        table = self.counts.view(np.uint64)[:, 0]
        for k, at in enumerate(slots):
            both = table[at].view(np.float32).reshape(-1, 2)
            zeros, ones = both[:, 0], both[:, 1]
            if own is not None:
                zeros, ones = np.maximum(zeros - (own & (bit == 0)), 0), np.maximum(ones - (own & (bit == 1)), 0)
            stretch[:, k] = np.log((ones + np.float32(DELTA)) / (zeros + np.float32(DELTA)))
            seen.append(zeros + ones)
        return stretch, seen

    def mix(self, stretch: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", stretch, self.weights[gate]), -12, 12)

    def place(self, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.clip(mixed * 2 + STEPS // 2, 0, STEPS - 1.001)
        low = x.astype(np.int32)
        return low, x - low.astype(np.float32)

    def probability(self, mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Of a one: the mean of the mixed and the refined probability."""
        low, part = self.place(mixed)
        cell, flat_refine = gate * STEPS + low, self.refine.ravel()
        refined = flat_refine[cell] * (1 - part) + flat_refine[cell + 1] * part
        return np.clip(0.5 * (1 / (1 + np.exp(-mixed)) + refined), 1e-5, 1 - 1e-5)

    def learn(self, slots: list[np.ndarray], gate, bit: np.ndarray) -> None:
        """One step: predict, then move weights and refinement against the error, then count."""
        stretch, seen = self.inputs_of(slots)
        gate = gate(seen) if callable(gate) else gate
        mixed = self.mix(stretch, gate)
        n, y = np.bincount(gate, minlength=self.gates), bit.astype(np.float32)
        error = y - 1 / (1 + np.exp(-mixed))
        rate = 0.5 / (1 + self.seen / 4_000_000)
        for k in range(self.inputs):
            self.weights[:, k] += rate * np.bincount(gate, error * stretch[:, k], self.gates) / (n + 50)
        low, part = self.place(mixed)
        cell, size = gate * STEPS + low + (part > 0.5), self.gates * STEPS
        wrong, met = np.bincount(cell, y - self.refine.ravel()[cell], size), np.bincount(cell, minlength=size)
        self.refine += (wrong / (met + 100)).reshape(self.refine.shape)
        self.hits += n[:, None]
        self.cells += met.reshape(self.cells.shape)
        np.clip(self.refine, 1e-5, 1 - 1e-5, out=self.refine)
        for s in slots:
            np.add.at(self.counts.reshape(-1), 2 * s + bit, np.float32(1))
        self.seen += len(bit)

    def log10(self, slots: list[np.ndarray], gate, bit: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each bit."""
        stretch, seen = self.inputs_of(slots, bit, own)
        gate = gate(seen) if callable(gate) else gate
        p = self.probability(self.mix(stretch, gate), gate)
        return np.log10(np.where(bit == 1, p, 1 - p))


def spell_gate(seen: list[np.ndarray]) -> np.ndarray:
    """How often the word so far and the three bytes before were seen."""
    return _log2(seen[2]) * 4 + _log2(seen[1]) // 4


class Model:
    """Mixers of level bits and of spelling bits."""

    def __init__(self):
        self.levels = Mixer(LEVEL_SLOTS * LEVEL_INPUTS, LEVEL_INPUTS, LEVEL_GATES)
        self.spelling = Mixer(sum(SIZES), len(SIZES), SPELL_GATES)

    def vector(self) -> np.ndarray:
        """Everything learned as sums: counts, and weights and refinement times the bits they saw."""
        out = []
        for m in (self.levels, self.spelling):
            out += [m.counts.ravel(), (m.weights * m.hits).ravel(), (m.refine * m.cells).ravel(), m.hits.ravel(), m.cells.ravel(), [m.seen]]
        return np.concatenate(out, dtype=np.float64)

    @classmethod
    def of(cls, vector: np.ndarray) -> Model:
        """The model of summed vectors; of none (all zero) an untrained one."""
        out, at = cls(), 0
        for m in (out.levels, out.spelling):
            shapes = [x.shape for x in (m.counts, m.weights, m.refine, m.hits, m.cells)] + [(1,)]
            size = [int(np.prod(x)) for x in shapes]
            counts, weights, refine, hits, cells, seen = (x.reshape(k) for x, k in zip(np.split(vector[at : at + sum(size)], np.cumsum(size)[:-1]), shapes, strict=True))
            at += sum(size)
            if hits.any():
                m.counts, m.seen, m.hits, m.cells = counts.astype(np.float32), float(seen[0]), hits, cells
                m.weights, m.refine = (weights / hits).astype(np.float32), (refine / cells).astype(np.float32)
        return out

    def learn(self, seg: Segment, tokens: Tokens) -> None:
        """Train on the segment's training texts, in their order."""
        for part in tokens.chunks():
            train = seg.train[part.a : part.b]
            at = np.flatnonzero(train[part.token])
            for k in range(0, len(at), BATCH):
                x = at[k : k + BATCH]
                self.levels.learn([s[x] for s in part.slots], part.gate[x], part.bit[x])
            new = part.spelled[train[part.spelled]]
            for k in range(0, len(new), WORDS):
                for _, bit, slots in spell_bits(*part.to_spell(new[k : k + WORDS])):
                    self.spelling.learn(slots, spell_gate, bit)

    def log10(self, seg: Segment, tokens: Tokens) -> np.ndarray:
        """log10 probability of every token."""
        every = []
        for part in tokens.chunks():
            out = part.share.copy()
            for k in range(0, len(part.token), BATCH):
                x = slice(k, k + BATCH)
                p = self.levels.log10([s[x] for s in part.slots], part.gate[x], part.bit[x])
                out += np.bincount(part.token[x], p, len(out))
            for k in range(0, len(part.spelled), WORDS):
                at = part.spelled[k : k + WORDS]
                own = seg.train[at + part.a]
                for word, bit, slots in spell_bits(*part.to_spell(at)):
                    out[at] += np.bincount(word, self.spelling.log10(slots, spell_gate, bit, own[word]), len(at))
            every.append(out)
        return np.concatenate(every)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def train(every: DataFrame, tokens: int, texts: int) -> Model:
    """Each segment trains a model; their vectors, in whole units, are summed by task and then slice by slice in Spark."""
    schema = "part bigint, data binary"

    def slices(vector: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part in range(-(-len(vector) // SLICE)):
            piece = vector[part * SLICE : (part + 1) * SLICE]
            if piece.any():
                yield pa.record_batch([pa.array([part], pa.int64()), pa.array([_squeezed(piece.tobytes())], pa.binary())], names=["part", "data"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for row in _rows(batches):
            seg, model = Segment(row), Model()
            model.learn(seg, Tokens(seg, row, tokens, texts))
            learned = np.rint(model.vector() * UNIT).astype(np.int64)
            total = total + learned if len(total) else learned
        yield from slices(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                piece = np.frombuffer(_full(data.as_py()), np.int64)
                total[part] = total[part] + piece if part in total else piece
        for part, piece in total.items():
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([_squeezed(piece.tobytes())], pa.binary())], names=["part", "data"])

    vector = np.zeros(len(Model().vector()), np.int64)
    for row in every.mapInArrow(work, schema).repartition("part").mapInArrow(add, schema).collect():  # one vector of fixed size
        piece = np.frombuffer(_full(row["data"]), np.int64)
        vector[row["part"] * SLICE : row["part"] * SLICE + len(piece)] = piece
    return Model.of(vector / UNIT)


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"


def score(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row."""
    sc = documents.sparkSession.sparkContext
    held = stored(segments(documents), "segments")
    freed(documents.sparkSession)  # the exchange of texts
    ends = F.arrays_zip(F.col("held").alias("held"), F.col("ends").alias("e"), F.concat(F.array(F.lit(0).cast("long")), F.col("ends")).alias("b"))
    train_texts = F.filter(ends, lambda x: x["held"] == F.lit(False))
    all_tokens, tokens, texts = held.select(F.element_at("ends", -1).alias("n"), F.aggregate(train_texts, F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["b"]).alias("t"), F.size(train_texts).alias("d")).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "t", "d")]).first()
    told = stored(answers(ask(held, max(0, int(np.ceil(np.log2(max(1, all_tokens / PART_KEYS))))))), "answers")
    freed(documents.sparkSession)  # the exchange of contexts is the largest
    distinct = told.where(F.col("ord") == ORDERS.index("w")).agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    every = stored(counted(held, told), "counted")
    dropped(held)
    dropped(told)
    model = sc.broadcast(train(every, tokens, texts))
    norm = float(np.log10(tokens + distinct + 1))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            seg = Segment(row)
            counts = Tokens(seg, row, tokens, texts)
            by_doc = lambda x: np.add.reduceat(x, seg.start)  # noqa: B023, E731
            result = by_doc(model.value.log10(seg, counts))
            yield pa.record_batch(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(seg.held),
                    pa.array(seg.ends - seg.start),
                    pa.array(by_doc((counts.plain > 0).astype(np.int64))),
                    pa.array(np.full(len(seg.ends), tokens, np.int64)),
                    pa.array(by_doc(np.log10(counts.plain + 1.0) - norm)),
                    pa.array(result),
                    pa.array(-result / np.log10(2) / np.maximum(np.asarray(row["sizes"]), 1)),
                ],
                names=[f.split()[0] for f in SCORED.split(", ")],
            )

    return every.mapInArrow(rate, SCORED)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
