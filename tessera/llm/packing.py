"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens. A window is WINDOW sequences; it visits the
queues in turn and each sends its quota, its target share of the window plus the
deficit it carries. The running quota has a closed form: with weights v_s of sum V,
after w windows of W tokens queue s has sent floor(w*W*v_s/V) tokens and carries
the fraction as deficit. So the token at place t of a queue has a known place in
the packed stream whatever partition holds it: deficits carry across windows and
partitions without one worker waiting for another. Every document is packed; where
targets are given, a queue that has run dry leaves its share to the others, which
begins another phase of the same form. Without targets the weights are the sources'
shares of all tokens, and all queues end together.

The stream is cut into sequences of `capacity` tokens; what is left at the very
end is cut into powers of two, so no sequence needs padding. Documents are cut
where their quota or a sequence ends.

Texts are tokenised once, into a scratch table with each document's place in its
task's part of the queue; a small table of tokens by task and source then gives
the part's place in the whole queue. The MOST_QUEUES - 1 largest sources are a queue
each, all smaller ones share the last; the driver holds one number per queue.

Defined cases: a null or empty text is the end token alone; null sources form
one queue, after the others; sources without a target come when all others are
dry; repeated rows are packed each; an empty table gives no piece.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from itertools import chain
from operator import or_
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, sliced, table

CAPACITY, WINDOW, END_ID = 4096, 64, 2
#: Most rows of the table of queue parts that are broadcast; above, it is joined by shuffle.
BROADCAST_ROWS = 200_000
MOST_QUEUES = 256
_MEMO_WORDS, _MEMO_CHARS = 600_000, 48
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary() -> str:
    """Path of the default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The vocabulary's pre-tokeniser pattern, and the printable Latin-1 characters it is applied to here.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_KNOWN = json.dumps(_PIECES.pattern)
_PLAIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\xff]+")


def _byte_names() -> dict[int, str]:
    """Characters that byte-level vocabularies write bytes as: printable ones as they are, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokens:
    """Token ids of whole texts, from a bounded memo of the ids of single words.

    The vocabulary's pre-tokeniser never joins across ASCII white space, so a
    text's ids are its words' ids in turn. Upper and lower case share an entry
    where lower-casing is one to one (Latin-1 texts without special tokens). With
    a vocabulary of another pre-tokeniser whole texts go through the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Only the known pre-tokeniser is taken apart; any other vocabulary goes through the library as a whole.
        self.byte_level = _KNOWN in Path(path).read_text(encoding="utf-8")[:4000]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 65536 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}
        self.names = _byte_names()

    def _split(self, text: str) -> list[str]:
        if not self.byte_level:
            return [text]
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        for space in "\n\t\r\x0b\x0c":
            text = text.replace(space, " ")
        return text.split(" ")

    def _piece(self, piece: str) -> list[int]:
        """Ids of one pre-token of Latin-1 characters, by the model alone."""
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= _MEMO_WORDS // 2:
                self.pieces.clear()
            named = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.names)
            found = self.pieces[piece] = [t.id for t in self.tokenizer.model.tokenize(named)]
        return found

    def encode(self, texts: list[str | None], end: bytes) -> list[bytes]:
        """Little-endian ids of each text, each with the end token."""
        lists = [self._split(t) if t else [] for t in texts]
        memo = self.memo
        missing = [w for w in set(chain.from_iterable(lists)) if w not in memo]
        if len(memo) + len(missing) > _MEMO_WORDS:
            memo.clear()
            missing = list(set(chain.from_iterable(lists)))
        fresh, rest = {}, []
        for word in missing:
            if len(word) <= _MEMO_CHARS and _PLAIN.fullmatch(word) and "<|" not in word and self.byte_level:
                fresh[word] = np.array([i for piece in _PIECES.findall(word.lower()) for i in self._piece(piece)], self.kind).tobytes()
            else:
                rest.append(word)
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                fresh[word] = np.array(found.ids, self.kind).tobytes()
        long = {w: fresh.pop(w) for w in [w for w in fresh if len(w) > _MEMO_CHARS]}
        memo.update(fresh)
        get = (memo | long).__getitem__ if long and len(memo) < 1000 else (lambda w: memo[w] if w in memo else long[w]) if long else memo.__getitem__
        return [b"".join(map(get, words)) + end for words in lists]


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Per row: part (of the queue, one per task), source, place (in that part), tokens, ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("source", pa.string()), ("place", pa.int64()), ("tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(path)
        end, part, sent = np.array([end_id], tokens.kind).tobytes(), TaskContext.get().partitionId(), {}
        for batch in sliced(batches):
            ids = tokens.encode(batch.column("text").to_pylist(), end)
            counts = [len(x) // tokens.kind.itemsize for x in ids]
            sources, places = batch.column("source").to_pylist(), []
            for source, n in zip(sources, counts, strict=True):
                places.append(sent.get(source, 0))
                sent[source] = places[-1] + n
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array([part] * len(ids), pa.int64()), pa.array(sources, pa.string()), pa.array(places, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(run, "doc_id long, part long, source string, place long, tokens long, ids binary")


@dataclass
class Phase:
    """A stretch of the stream in which the same queues have tokens left: its begin, what each queue sent before and sends in it, and the weights."""

    begin: int
    before: list[int]
    sends: list[int]
    weights: list[int]
    all: int


class Layout:
    """Where the token at a place of a queue goes: closed-form deficit round-robin to the weights (the totals, where none are given)."""

    def __init__(self, totals: list[int], capacity: int = CAPACITY, window: int = WINDOW, weights: list[int] | None = None):
        self.totals, self.all, self.capacity, self.width = totals, sum(totals), capacity, capacity * window
        self.whole = self.all // capacity * capacity
        left, self.tail = self.all - self.whole, []
        begin = self.whole
        while left:
            size = 1 << (left.bit_length() - 1)
            self.tail.append((begin, size))
            begin, left = begin + size, left - size
        self.phases: list[Phase] = []
        begin, before = 0, [0] * len(totals)
        while begin < self.all:
            left = [t - s for t, s in zip(totals, before, strict=True)]
            now = [w if n else 0 for w, n in zip(weights or totals, left, strict=True)]
            now = now if any(now) else left
            # The queue that runs dry first ends the phase; the others have sent in proportion by then.
            first = min((q for q in range(len(now)) if now[q]), key=lambda q: Fraction(left[q], now[q]))
            sends = [left[first] * w // now[first] for w in now]
            self.phases.append(Phase(begin, before, sends, now, sum(now)))
            begin, before = begin + sum(sends), [s + n for s, n in zip(before, sends, strict=True)]
        self._begins: dict[tuple[int, int], list[int]] = {}

    def sent(self, phase: int, queue: int, windows: int) -> int:
        """Tokens that a queue has sent after so many windows of the phase."""
        p = self.phases[phase]
        return min(windows * self.width * p.weights[queue] // p.all, p.sends[queue])

    def begin(self, phase: int, queue: int, window: int) -> int:
        """Place in the stream of the queue's first token of the window."""
        if (phase, window) not in self._begins:
            if len(self._begins) > 256:
                self._begins.clear()
            at, out = self.phases[phase].begin + sum(self.sent(phase, q, window) for q in range(len(self.totals))), []
            for q in range(len(self.totals)):
                out.append(at)
                at += self.sent(phase, q, window + 1) - self.sent(phase, q, window)
            self._begins[phase, window] = out
        return self._begins[phase, window][queue]

    def sequence(self, at: int) -> tuple[int, int, int]:
        """(sequence, offset in it, its length) of a place in the stream."""
        if at < self.whole:
            return at // self.capacity, at % self.capacity, self.capacity
        for k, (begin, size) in enumerate(self.tail):
            if at < begin + size:
                return self.whole // self.capacity + k, at - begin, size
        raise ValueError("beyond the stream")

    def pieces(self, queue: int, begin: int, tokens: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset) of tokens begin:begin+tokens of a queue."""
        at, end = begin, begin + tokens
        for k, p in enumerate(self.phases):
            first, last = p.before[queue], p.before[queue] + p.sends[queue]
            if at >= last or not p.sends[queue]:
                continue
            window = (at - first) * p.all // (p.weights[queue] * self.width)
            while self.sent(k, queue, window) > at - first:
                window -= 1
            while at < min(end, last):
                while self.sent(k, queue, window + 1) <= at - first:
                    window += 1
                stream = self.begin(k, queue, window) + at - first - self.sent(k, queue, window)
                run = min(end, first + self.sent(k, queue, window + 1)) - at
                while run:
                    sequence, offset, size = self.sequence(stream)
                    n = min(run, size - offset)
                    yield at - begin, n, sequence, offset
                    at, stream, run = at + n, stream + n, run - n
            if at == end:
                return


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, window: int = WINDOW, end_id: int = END_ID, targets: dict[str | None, float] | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    targets: the share of each source that every window is to hold while the source lasts.
    """
    scratch = Scratch(spark)
    marked = scratch.table(tokenised(docs, path or vocabulary(), end_id), "tokens")
    parts = scratch.table(marked.groupBy("source", "part").agg(F.sum("tokens").alias("held")), "parts")
    by_source = parts.groupBy("source").agg(F.sum("held").alias("held"))
    everything = parts.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    aimed = [F.col("source").eqNullSafe(F.lit(t)) for t in targets or ()]
    first = by_source.withColumn("aimed", reduce(or_, aimed, F.lit(False)))
    largest = first.orderBy(F.desc("aimed"), F.desc("held"), "source").limit(MOST_QUEUES - 1).collect()
    order = sorted(largest, key=lambda r: (r.source is None, (r.source or "").encode()))
    totals = [r.held for r in order]
    totals += [everything - sum(totals)] if everything > sum(totals) else []
    weights = None if targets is None else [*(round(1_000_000 * targets.get(r.source, 0)) for r in order), *[0] * (len(totals) - len(order))]
    queues = spark.createDataFrame([(r.source, k) for k, r in enumerate(order)], "of string, queue int")
    queued = parts.join(F.broadcast(queues), F.col("source").eqNullSafe(F.col("of")), "left").select("source", "part", "held", F.coalesce("queue", F.lit(len(order))).alias("queue"))
    before = Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.table(queued.select(F.col("source").alias("of"), F.col("part").alias("in_part"), "queue", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base")), "base")
    kind = np.dtype("<u2" if WordTokens(path or vocabulary()).kind.itemsize == 2 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(totals, capacity, window, weights)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, queue, begin, tokens, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "begin", "tokens", "ids")), strict=True):
                wide = memoryview(np.frombuffer(ids, kind).astype("<u4").tobytes())
                out += [(doc_id, start, n, zlib.crc32(wide[4 * start : 4 * (start + n)]), tokens, sequence, offset) for start, n, sequence, offset in layout.pieces(queue, begin, tokens)]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    base = F.broadcast(base) if base.count() <= BROADCAST_ROWS else base
    placed = marked.join(base, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")))
    return placed.select("doc_id", "queue", (F.col("base") + F.col("place")).alias("begin"), "tokens", "ids").mapInArrow(run, _PIECE)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
