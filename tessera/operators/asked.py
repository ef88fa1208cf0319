"""BM25 of a batch of questions, scored where the documents lie.

Only words that a question asks add to a score. So every text is cut into words once and leaves one row: its length
and how often it holds each asked word. Document frequencies are counted from these rows, and scores are sparse
products over batches of them. Of the documents of a task only those leave it that can be among the first k of a
question in their domain, hence neither postings nor scores are shuffled.

Questions go to the tasks as one broadcast of numbers of their words, at most about MOST at a time: larger batches
are asked in parts. Ids of documents are longs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField

from tessera.functions.text import tokens
from tessera.operators.index import K1, B, bm25_weights, namespace_stats

#: Words of the questions of one part, about; products of a slice of documents with questions.
MOST, _SLICE = 200_000, 1 << 20


@dataclass
class Asked:
    """The words of a batch of questions: items[k] asks word at[i] qtf[i] times for i in starts and ends of the word."""

    items: list
    terms: list[str]
    starts: np.ndarray
    item: np.ndarray
    qtf: np.ndarray

    @classmethod
    def of(cls, query_terms: DataFrame, key: str) -> Asked:
        """Of (key, term, qtf)."""
        rows = query_terms.select(key, "term", "qtf").collect()
        items, terms = sorted({r[0] for r in rows}, key=lambda i: (i is None, i)), sorted({r[1] for r in rows})
        at, of = {t: k for k, t in enumerate(terms)}, {i: k for k, i in enumerate(items)}
        rows.sort(key=lambda r: (at[r[1]], of[r[0]]))
        held = np.array([at[r[1]] for r in rows], np.int64)
        return cls(items, terms, np.searchsorted(held, np.arange(len(terms) + 1)), np.array([of[r[0]] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64))

    def met(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `at`, place in item and qtf) of every question that asks one of these words."""
        many = self.starts[at + 1] - self.starts[at]
        place = np.repeat(np.arange(len(at)), many)
        return place, np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + self.starts[at][place]


def in_parts(query_terms: DataFrame, key: str, most: int = MOST) -> list[DataFrame]:
    """Whole questions of (key, term, qtf), dealt to parts of about `most` words."""
    n = -(-query_terms.count() // most)
    return [query_terms.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)] if n > 1 else [query_terms]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32()))


def asked_counts(units: DataFrame, asked: Asked, text: str = "text") -> DataFrame:
    """domain, doc_id, len, at, tf of units (domain, doc_id, text): words by their number among those asked, and how often each occurs."""
    shared = units.sparkSession.sparkContext.broadcast(asked.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for batch in batches:
            words = batch.column("words")
            sizes = pc.fill_null(words.value_lengths(), 0).to_numpy()
            found = pc.fill_null(pc.index_in(words.flatten(), known), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)[found >= 0]
            pairs, tf = np.unique(row * max(1, len(known)) + found[found >= 0], return_counts=True)
            ends = np.cumsum(np.bincount(pairs // max(1, len(known)), minlength=len(sizes)))
            yield pa.record_batch([batch.column("domain"), batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), _lists(pairs % max(1, len(known)), ends), _lists(tf, ends)], names=["domain", "doc_id", "len", "at", "tf"])

    return units.select("domain", "doc_id", tokens(text).alias("words")).mapInArrow(run, "domain string, doc_id long, len long, at array<int>, tf array<int>")


def weights(counts: DataFrame, asked: Asked) -> dict[str, tuple[np.ndarray, float]]:
    """By domain the idf of each asked word and the mean length; statistics cover all documents."""
    df = counts.select("domain", F.explode("at").alias("term")).groupBy("domain", "term").agg(F.count("*").alias("df"))
    spaces = namespace_stats(counts)
    out = {r.domain: (np.zeros(len(asked.terms)), float(r.avg_len)) for r in spaces.collect()}
    for r in bm25_weights(df, spaces).select("domain", "term", "idf").collect():  # numbers of asked words, not of all
        out[r.domain][0][r.term] = r.idf
    return out


class Best:
    """The first k of each question: by score of so many digits, as numbers round half up, then by doc_id.

    A score so near half a digit that summing in another order could round it elsewhere counts both ways, so nothing that
    is among the first k leaves; what is kept may be a little more.
    """

    def __init__(self, items: int, k: int, digits: int):
        self.k, self.scale = k, 10.0**digits
        self.least = np.full(items, -np.inf)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.size, self.room = 0, 4 * k * items + 4096

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        good = (score > 0) & (score * self.scale + 0.5 + 1e-6 >= self.least[item])
        self.held.append((item[good], doc[good], score[good]))
        self.size += len(self.held[-1][0])
        if self.size > self.room:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, doc, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        low = np.floor(score * self.scale + 0.5 - 1e-6)
        order = np.lexsort((doc, -low, item))
        item, doc, score, low = item[order], doc[order], score[order], low[order]
        starts = np.searchsorted(item, np.arange(len(self.least) + 1))
        last = starts[:-1] + self.k - 1  # the k-th of each question that has one
        full = last < starts[1:]
        self.least[full] = low[last[full]]
        high, at = np.floor(score * self.scale + 0.5 + 1e-6), np.minimum(last, max(0, len(doc) - 1))[item]
        keep = ~full[item] | (high > self.least[item]) | ((high == self.least[item]) & (doc <= doc[at])) if len(doc) else np.zeros(0, bool)
        self.held, self.size = [(item[keep], doc[keep], score[keep])], int(keep.sum())
        return self.held[0]


def best_scores(counts: DataFrame, asked: Asked, key: StructField, k: int, digits: int) -> DataFrame:
    """key, domain, doc_id, lexical: of each task's documents those that can be among the first k of a question in their domain."""
    shared = counts.sparkSession.sparkContext.broadcast((asked, weights(counts, asked)))
    schema, kind = f"`{key.name}` {key.dataType.simpleString()}, domain string, doc_id long, lexical double", to_arrow_type(key.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weighed = shared.value
        best = {d: Best(len(asked.items), k, digits) for d in weighed}
        for batch in batches:
            sizes, doc = batch.column("at").value_lengths().to_numpy(), batch.column("doc_id").to_numpy()
            at, tf = batch.column("at").flatten().to_numpy().astype(np.int64), batch.column("tf").flatten().to_numpy()
            length, names = batch.column("len").to_numpy(), np.array(batch.column("domain").to_pylist(), object)
            row = np.repeat(np.arange(len(sizes)), sizes)
            work = np.maximum(len(asked.items), np.bincount(row, asked.starts[at + 1] - asked.starts[at], len(sizes)))
            part = (np.cumsum(work) // _SLICE).astype(np.int64)
            for d, (idf, mean) in weighed.items():
                for p in np.unique(part[names == d]).tolist():
                    here = np.flatnonzero((names == d) & (part == p))
                    place = np.full(len(sizes), -1)
                    place[here] = np.arange(len(here))
                    own = place[row] >= 0
                    word, often, of = at[own], tf[own], place[row[own]]
                    impact = idf[word] * often * (K1 + 1) / (often + K1 * (1 - B + B * length[here][of] / mean))
                    one, question = asked.met(word)
                    cells = of[one] * len(asked.items) + asked.item[question]
                    score = np.bincount(cells, asked.qtf[question] * impact[one], len(here) * len(asked.items))
                    hit = np.flatnonzero(score)
                    best[d].add(hit % len(asked.items), doc[here][hit // len(asked.items)], score[hit])
        for d, found in best.items():
            item, doc, score = found.cut()
            yield pa.record_batch([pa.array([asked.items[i] for i in item.tolist()], kind), pa.array([d] * len(item), pa.string()), pa.array(doc, pa.int64()), pa.array(score, pa.float64())], names=[key.name, "domain", "doc_id", "lexical"])

    return counts.mapInArrow(run, schema)
