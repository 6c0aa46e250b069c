"""Token counts by a compiled finite-state tokenizer.

A piece vocabulary with scores (merges of the best-scored neighbours first) is compiled into a deterministic transducer over characters. Its
states are what of the text read so far can still matter: the longest suffix that some piece starts with, and, at each place in
it, the last token of the text up to there and the tokens counted to there. A transition carries the change of the token
count. It rests on two facts about merging: the tokens of a text up to one of its token ends are the tokens of that part alone,
and tokens stand side by side in a text's tokens if each two neighbours do so by themselves. States and transitions are compiled when they are first
met; the table is emptied when it is full, as states name themselves.

Two neighbouring characters that no piece holds are always parted, so the state behind such a place depends on nothing before.
A chunk of text therefore maps the state it is entered with as follows: its head up to the first such place, which waits for the chunk
before; the count up to the last such place; and its tail, which names the state it is left with. These maps compose associatively
(``compose``), and ``scan`` composes them by a parallel prefix scan. Texts of over ``LONG`` characters are cut into chunks that are
dealt out to all tasks; equal ones are counted once.

Defined results: a null text counts as empty, an empty text has no tokens; every other text is read behind one blank, as the library does by
default; strings of special tokens are plain text; characters without a piece count as their UTF-8 bytes; repeated rows each
have their row; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import _moved, aside

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Texts of more characters are counted in chunks of CHUNK characters, by all tasks.
LONG, CHUNK = 1 << 22, 1 << 18
#: Most states, remembered neighbours and words of a task, and the longest word that is remembered.
STATES, WORDS, LETTERS = 300_000, 1_000_000, 48
BLANK = "▁"

#: (head, None) of a chunk without a certain cut, else (head, (count, tail)).
Map = tuple[str, tuple[int, str] | None]


def vocabulary(path: str) -> dict[str, float]:
    """Piece to score of all pieces that merging may give."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    of = range(m.get_piece_size())
    return {m.id_to_piece(i): m.get_score(i) for i in of if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))}


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """Tokens of a short text, by merging alone: the best-scored pair first, the leftmost of equals."""
    out = list(text)
    while True:
        best, at = None, -1
        for i in range(len(out) - 1):
            s = scores.get(out[i] + out[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            return out
        out[at : at + 2] = [out[at] + out[at + 1]]


class Transducer:
    """Compiled vocabulary. ``run`` reads characters; a state is a number, 0 the one at a certain cut."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.pairs = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.starts = {p[:i] for p in scores for i in range(1, len(p) + 1)}
        letters = {c for p in scores for c in p}
        if any(p[1] == BLANK != p[0] for p in self.pairs):
            raise ValueError("blanks inside words are not supported: no piece may have a blank behind another character")
        # a word has its blanks in front; characters that no piece holds may stand in a word: the transducer cuts there
        alone = "".join(c for c in "\n\r\t" if c not in letters)
        self.word = re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (f"|[{alone}]" if alone else ""))
        self.reset()

    def reset(self) -> None:
        self.named, self.states, self.steps, self.fit = {("", (None,), (0,)): 0}, [("", (None,), (0,))], [{}], {}
        self.words: dict[str, int] = {}

    def fits(self, a: str | None, b: str) -> bool:
        """Whether token ``b`` may follow token ``a`` (None: a certain cut)."""
        found = self.fit.get((a, b))
        if found is None:
            if a is None:
                found = merged(b, self.scores) == [b]
            else:
                found = merged(a + b, self.scores) == [a, b]
            self.fit[a, b] = found
        return found

    def step(self, state: int, c: str) -> tuple[int, int]:
        """Compile the transition: (next state, tokens emitted)."""
        text, last, count = self.states[state]
        if not text or text[-1] + c not in self.pairs:
            text, last, count = "", (None,), (0,)
        now = text + c
        for k in range(len(now)):  # one token ends here; the longest is tried first
            t = now[k:]
            if (t in self.scores or len(t) == 1) and self.fits(last[k], t):
                break
        else:
            raise AssertionError("one token always ends here")
        emitted = count[k] + (1 if t in self.scores else len(t.encode("utf-8", "surrogatepass")))
        last, count = (*last, t), (*(n - emitted for n in count), 0)
        cut = next((i for i in range(len(now)) if now[i:] in self.starts), len(now))
        name = ("", (None,), (0,)) if cut == len(now) else (now[cut:], last[cut:], count[cut:])
        to = self.named.get(name)
        if to is None:
            to = self.named[name] = len(self.states)
            self.states.append(name)
            self.steps.append({})
        self.steps[state][c] = found = (to, emitted)
        return found

    def run(self, text: str) -> int:
        """Tokens of ``text`` between two certain cuts."""
        state = count = 0
        for c in text:
            found = self.steps[state].get(c)
            if found is None:
                if len(self.states) > STATES or len(self.fit) > STATES:
                    name = self.states[state]
                    self.reset()
                    state = self.named.setdefault(name, len(self.states))
                    if state == len(self.states):
                        self.states.append(name)
                        self.steps.append({})
                found = self.step(state, c)
            state, emitted = found
            count += emitted
        return count

    def of_word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            found = self.run(word)
            if len(word) <= LETTERS:
                if len(self.words) >= WORDS:
                    self.words = {}
                self.words[word] = found
        return found

    def mapped(self, chunk: str) -> Map:
        """What a chunk (blanks already as ``BLANK``) does to the state it is entered with."""
        parts = self.word.findall(chunk)
        if len(parts) < 2:
            return chunk, None
        return parts[0], (sum(map(self.of_word, parts[1:-1])), parts[-1])

    def compose(self, a: Map, b: Map) -> Map:
        if a[1] is None and b[1] is None:
            both = self.word.findall(a[0] + b[0])
            return (a[0] + b[0], None) if len(both) < 2 else (both[0], (sum(map(self.of_word, both[1:-1])), both[-1]))
        if a[1] is None:
            head, (count, tail) = self.compose(a, (b[0], None)), b[1]
            return (head[0], b[1]) if head[1] is None else (head[0], (head[1][0] + self.run(head[1][1]) + count, tail))
        count, tail = a[1]
        if b[1] is None:
            return a[0], self._grown(count, tail, b[0])
        done, last = self._grown(count, tail, b[0])
        return a[0], (done + self.run(last) + b[1][0], b[1][1])

    def _grown(self, count: int, tail: str, more: str) -> tuple[int, str]:
        parts = self.word.findall(tail + more)
        return count + sum(map(self.of_word, parts[:-1])), parts[-1] if parts else ""

    def closed(self, m: Map) -> int:
        """Tokens of a whole text that maps so."""
        return self.run(m[0]) + (0 if m[1] is None else m[1][0] + self.run(m[1][1]))

    def scan(self, maps: list[Map]) -> list[Map]:
        """All prefixes' compositions, in as many rounds as the logarithm of their number: neighbours first, then the rest from theirs."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)])
        return [maps[0] if not i else pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i]) for i in range(len(maps))]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.of_word, self.word.findall(escaped(text))))


def escaped(text: str) -> str:
    return BLANK + text.replace(" ", BLANK)


_compiled: dict[str, Transducer] = {}


def _mine(shared: Shared) -> Transducer:
    """This worker's transducer; its tables outlive the task."""
    if shared.id not in _compiled:
        _compiled.clear()
        _compiled[shared.id] = Transducer(shared.value)
    return _compiled[shared.id]


class Shared:
    """A vocabulary that all tasks see: a broadcast of its bounded number of pieces."""

    def __init__(self, df: DataFrame, path: str):
        self.sent = df.sparkSession.sparkContext.broadcast(vocabulary(path))
        self.id = uuid.uuid4().hex

    @property
    def value(self) -> dict[str, float]:
        return self.sent.value


def chunked(texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(digest, text) to (digest, no, part), the text's blank in front included."""
    n = F.ceil(F.char_length("text") / F.lit(chunk)).cast("int")
    rows = texts.select("digest", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("no"))
    return rows.select("digest", "no", F.substring("text", F.col("no") * chunk + 1, F.lit(chunk)).alias("part"))


def long_counts(texts: DataFrame, shared: Shared, chunk: int = CHUNK) -> DataFrame:
    """(digest, n_tokens) of distinct non-empty texts (digest, text): their chunks are mapped by all tasks, and the maps composed."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _mine(shared)
        for b in batches:
            got = [t.mapped(escaped(p) if no == 0 else escaped(p)[1:]) for no, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = [pa.array([m[0] for m in got], pa.string()), pa.array([None if m[1] is None else m[1][0] for m in got], pa.int64()), pa.array([None if m[1] is None else m[1][1] for m in got], pa.string())]
            yield pa.record_batch([b.column(0), b.column(1), *cols], names=["digest", "no", "head", "count", "tail"])

    def composed(group: pa.Table) -> pa.Table:
        t, rows = _mine(shared), sorted(group.to_pylist(), key=lambda r: r["no"])
        every = t.scan([(r["head"], None if r["count"] is None else (r["count"], r["tail"])) for r in rows])
        return pa.table({"digest": pa.array([rows[0]["digest"]], pa.string()), "n_tokens": pa.array([t.closed(every[-1])], pa.int64())})

    maps = chunked(texts, chunk).repartition("digest", "no").mapInArrow(mapped, "digest string, no int, head string, count bigint, tail string")
    return maps.groupBy("digest").applyInArrow(composed, "digest string, n_tokens bigint")


def with_counts(documents: DataFrame, path: str, long: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """``documents`` with ``_w_tokens`` (columns set aside, see ``common.aside``)."""
    shared, docs = Shared(documents, path), aside(documents)
    text = F.coalesce("text", F.lit(""))
    schema = docs.withColumn("_w_tokens", F.lit(0).cast("bigint")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _mine(shared)
        for b in batches:
            got = pa.array([t.count(x.as_py()) for x in b.column(b.schema.get_field_index("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, "_w_tokens"])

    short = docs.where(F.char_length(text) <= long).mapInArrow(count, schema)
    digest = F.sha2(F.encode("text", "UTF-8"), 256)
    big = docs.where(F.char_length("text") > long)
    counted = long_counts(big.select(digest.alias("digest"), "text").dropDuplicates(["digest"]), shared, chunk)
    joined = big.withColumn("_w_digest", digest).join(counted.select(F.col("digest").alias("_w_digest"), F.col("n_tokens").alias("_w_tokens")), "_w_digest")
    return short.unionByName(joined.select(*short.columns))


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``documents`` with n_bytes, n_tokens and over_limit behind its own columns, which keep their values (of equal names, the operator's win)."""
    counted = with_counts(documents, path)
    own = [c for c in documents.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    out = {"n_bytes": F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), "n_tokens": F.col("_w_tokens"), "over_limit": F.col("_w_tokens") > limit}
    kept = counted.withColumns({f"_w_out_{c}": v for c, v in out.items()})
    return kept.select(*[F.col(f"`{_moved(c)}`").alias(c) for c in own], *[F.col(f"_w_out_{c}").alias(c) for c in out])


def op12_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path(MODEL)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
