"""Language ID by cross-parsing entropy with suffix automata.

A suffix automaton of labelled text per language gives the longest match of any
text with it. A document is cut greedily into such matches; phrases times
log2(training length) over its length estimates the bits a character costs in
that language (Ziv and Merhav, 1993), and the cheapest language wins. The score
is one less the ratio of the cheapest to the next.

Letters are lower-cased, everything between letters is one space. Documents are
parsed in stretches of BLOCK characters, all stretches and all languages of a
slice in lock-step through one transition table, so a step is a numpy gather and
not a Python loop per character. The table is dense while it stays under
DENSE_BYTES, else hashed, at about 50 bytes a transition whatever the alphabet.

The automata come from a bounded sample: per language FIT_DOCS documents that hold
a letter, those of at most FIT_CHARS characters first, by hashed id, then the
shortest others, of which FIT_CHARS characters are learnt. With very many
languages both bounds shrink, so that FIT_TOTAL characters are learnt in all.

Defined cases: `und` with score 0 for null text, text without a letter, or where
no language can be learnt; equal costs go to the language first by code point;
null ids are not learnt from; every row gets its own result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, held_out, sliced, table
from tessera.llm.textblocks import utf8

FIT_DOCS, FIT_CHARS, BLOCK = 24, 3000, 2048
#: Characters learnt in all, and bytes of the dense table beyond which transitions are hashed.
FIT_TOTAL, DENSE_BYTES = 8_000_000, 128 << 20
UNKNOWN, SPACE, DOCUMENT_END = 0, 1, 2
UND = "und"


def symbols(alphabet: str) -> np.ndarray:
    """code point -> symbol: letters of the alphabet from 3 on, other letters UNKNOWN, the rest SPACE."""
    place = {c: k + 3 for k, c in enumerate(alphabet)}
    out = np.full(0x110000, SPACE, np.uint16)
    for c in range(0x110000):
        if (char := chr(c)).isalpha():
            out[c] = place.get(char.lower()[0], UNKNOWN)
    return out


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings of a symbol string (Blumer et al., 1985)."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and symbol not in moves[p]:
            moves[p][symbol] = new
            p = link[p]
        if p != -1:
            q = moves[p][symbol]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p != -1 and moves[p].get(symbol) == q:
                    moves[p][symbol] = copy
                    p = link[p]
        last = new
    return moves


class Transitions:
    """Next state by (state, symbol), -1 for none: a dense table, or one of open addressing where that would be too big."""

    def __init__(self, states: np.ndarray, symbols: np.ndarray, to: np.ndarray, rows: int, width: int, dense_bytes: int = DENSE_BYTES):
        self.width, self.keys = width, None
        key = states.astype(np.int64) * width + symbols
        if 4 * rows * width <= dense_bytes:
            self.to = np.full(rows * width, -1, np.int32)
            self.to[key] = to
            return
        self.bits = max(4, int(4 * len(key)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):  # of those that want a free slot the first takes it; the others move on
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[slot[taken]], self.to[slot[taken]] = key[taken], to[taken]
            left = np.setdiff1d(left, taken, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + symbol
        if self.keys is None:
            return self.to[key]
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.to[slot], -1)
        i, j = np.nonzero((held != key) & (held >= 0))
        while len(i):
            slot[i, j] = (slot[i, j] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[i, j]]
            hit = held == key[i, j]
            out[i[hit], j[hit]] = self.to[slot[i[hit], j[hit]]]
            on = ~hit & (held >= 0)
            i, j = i[on], j[on]
        return out


class CrossParser:
    """Automata of several languages in one table; the first state of each is its root."""

    def __init__(self, texts: dict[str, list[str]], dense_bytes: int = DENSE_BYTES):
        self.languages = sorted(texts, key=str.encode)
        self.alphabet = "".join(sorted({c for parts in texts.values() for t in parts for c in t.lower() if c.isalpha()}))
        self.width = len(self.alphabet) + 3
        table_of, roots, cost = symbols(self.alphabet), [], []
        self.root_moves = np.full((len(self.languages), self.width), -1, np.int32)
        moved: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int32),) * 3]
        base = 0
        for k, language in enumerate(self.languages):
            joined = np.concatenate([np.append(_squeezed(table_of[np.array([ord(c) for c in t], np.int64)]), DOCUMENT_END) for t in texts[language]])
            joined = joined[joined != UNKNOWN]
            moves = suffix_automaton(joined)
            n = np.array([len(m) for m in moves])
            by = np.fromiter((s for m in moves for s in m), np.int32, n.sum())
            to = np.fromiter((t for m in moves for t in m.values()), np.int32, n.sum()) + base
            moved.append((np.repeat(np.arange(len(moves), dtype=np.int32) + base, n), by, to))
            self.root_moves[k, by[: n[0]]] = to[: n[0]]
            roots.append(base)
            cost.append(np.log2(max(2, len(joined))))
            base += len(moves)
        self.moves = Transitions(*(np.concatenate(c) for c in zip(*moved, strict=True)), base, self.width, dense_bytes)
        self.roots, self.cost = np.array(roots, np.int32), np.array(cost)

    def phrases(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (of symbols) in each language."""
        lengths = np.diff(offsets)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(lengths)), blocks)
        nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = offsets[:-1][owner] + nth * BLOCK
        size = np.minimum(BLOCK, offsets[1:][owner] - begin)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        k = len(self.languages)
        state = np.repeat(self.roots[None, :], len(begin), 0)
        count = np.zeros((len(begin), k), np.int32)
        live = np.searchsorted(-size, -np.arange(size[0]) if len(size) else [], "left")
        for step, n in enumerate(live.tolist()):
            symbol = text[begin[:n] + step].astype(np.int64)
            to = self.moves.next(state[:n], symbol[:, None])
            stuck = to < 0
            if stuck.any():
                again = self.root_moves[:, symbol].T
                # A phrase ends here, unless none was open; a symbol no root knows is a phrase of its own.
                count[:n] += stuck & (state[:n] != self.roots)
                count[:n] += stuck & (again < 0)
                to = np.where(stuck, np.where(again < 0, self.roots, again), to)
            state[:n] = to
        count += state != self.roots
        out = np.zeros((len(lengths), k), np.int64)
        np.add.at(out, owner, count)
        return out


def _squeezed(text: np.ndarray) -> np.ndarray:
    """Runs of SPACE as one."""
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != SPACE) | (text[:-1] != SPACE)
    return text[keep]


def predict(parser: CrossParser, table_of: np.ndarray, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    raw, at = utf8(column)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[at]
    text = table_of[points]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != SPACE) | (text[:-1] != SPACE)
    keep[at[:-1][at[:-1] < len(text)]] = True
    letters = np.concatenate(([0], np.cumsum(text != SPACE)))
    spelled = letters[at[1:]] > letters[at[:-1]]
    at = np.concatenate(([0], np.cumsum(keep)))[at]
    text = text[keep]
    if not parser.languages:
        return [UND] * len(spelled), np.zeros(len(spelled))
    bits = parser.phrases(text, at) * parser.cost / np.maximum(1, np.diff(at))[:, None]
    best = bits.argmin(1)
    ranked = np.sort(bits, 1)
    score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-12) if len(parser.languages) > 1 else np.ones(len(bits))
    return [parser.languages[b] if s else UND for b, s in zip(best.tolist(), spelled.tolist(), strict=True)], np.where(spelled, np.clip(score, 0, 1), 0.0)


def fit_languages(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, fit_total: int = FIT_TOTAL) -> CrossParser:
    """The automata, from at most fit_docs documents of at most fit_chars characters per language, fit_total in all."""
    text = F.col("text").cast("string")
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).where(F.rlike(text, F.lit("\\p{L}")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64(text).alias("tag"), text.alias("text"))
    rank = Window.partitionBy("lang").orderBy("beyond", F.xxhash64("doc_id"), "doc_id", "tag")
    sized = known.select("doc_id", "lang", "tag", F.greatest(F.length("text"), F.lit(fit_chars)).alias("beyond"))
    ranked = sized.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= fit_docs).groupBy("doc_id", "lang", "tag").agg(F.min("rank").alias("rank"))
    chosen = Scratch(docs.sparkSession).table(ranked, "chosen")
    languages = max(1, chosen.select("lang").distinct().count())
    chars = max(1, min(fit_chars, fit_total // languages))
    most = max(1, min(fit_docs, fit_total // (languages * chars)))
    mine = known.join(F.broadcast(chosen.where(F.col("rank") <= most).drop("rank")), ["doc_id", "lang", "tag"]).groupBy("doc_id", "lang", "tag").agg(F.first(F.substring("text", 1, chars)).alias("text"))
    texts: dict[str, list[str]] = {}
    for lang, text in sorted({(r.lang, r.text) for r in mine.select("lang", "text").collect()}):
        if any(c.isalpha() for c in text):
            texts.setdefault(lang, []).append(text)
    return CrossParser(texts)


def identify(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = symbols(shared.value.alphabet)
        for batch in sliced(batches, limit=6 << 20):
            language, score = predict(shared.value, table_of, batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(language, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the documents whose language cannot be told (`und`); lang becomes the prediction."""
    shared = spark.sparkContext.broadcast(fit_languages(docs))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = symbols(shared.value.alphabet)
        for batch in sliced(batches, limit=6 << 20):
            language, _ = predict(shared.value, table_of, batch.column("text"))
            arrays = [pa.array(language, pa.string()) if c == "lang" else batch.column(c) for c in columns]
            yield pa.record_batch(arrays, names=columns).filter(pa.array([x != UND for x in language]))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_languages(docs))
