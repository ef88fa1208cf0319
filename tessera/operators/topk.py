"""The best BM25 scores of each query, with postings skipped that cannot count.

Documents of a namespace are dealt to blocks of about BLOCK of about the same length. For each term a block
knows its largest impact (what the term adds to a score, without its number in the query), so the
sum over a query's terms bounds every score in the block. Each query first scores its
most promising blocks whole; its k-th score so far then rules out every block whose bound is
below it, and in the others the terms that even together stay below it: only a document with one of the
other, essential terms can still come in. Their postings name the candidates, whose own bound must hold
as well, and only for those the postings of the remaining terms are read. Results are those of scoring everything.

`ImpactIndex` holds all terms as postings and joins them, for indexes that outlive a batch. `best_by_blocks` does the
same for one batch over rows of asked words (`operators/asked.py`): a block is one row, and bounds, essential terms and scores are
made in the task that reads it, so what is written and shuffled is a block once, and no posting or score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField

from tessera.operators.asked import Asked, Best, weights
from tessera.operators.index import K1, B, bm25_weights, namespace_stats, term_stats

#: Documents of a block, about; blocks that each query looks at first.
BLOCK, FIRST = 32, 4


def _blocks(lens: DataFrame, keys: list[str], block: int) -> DataFrame:
    """lens with `block`. Lengths by quarters of octaves, then by hash: a block's documents are alike in length, and no group is sorted."""
    graded = lens.withColumn("grade", F.floor(4 * F.log2(F.col("len") + 1)).cast("int"))
    cuts = graded.groupBy("domain", "grade").agg(F.ceil(F.count("*") / block).alias("cuts"))
    named = F.concat_ws("/", F.col("grade").cast("string"), F.expr(f"pmod(xxhash64({', '.join(keys)}), cuts)").cast("string"))
    return graded.join(F.broadcast(cuts), ["domain", "grade"]).withColumn("block", named).drop("grade", "cuts")


@dataclass
class ImpactIndex:
    """impacts: domain, term, block, *keys, impact. maxima: domain, term, block, most, rows."""

    keys: list[str]
    impacts: DataFrame
    maxima: DataFrame

    @classmethod
    def build(cls, post: DataFrame, lens: DataFrame, keys: list[str], stored, block: int = BLOCK) -> ImpactIndex:
        """Of postings (domain among keys, term, tf) and lengths (keys, len); stored writes a table."""
        weighed = bm25_weights(term_stats(post, ["domain"]), namespace_stats(lens))
        of = _blocks(lens, keys, block).select(*keys, "len", "block")
        impact = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        impacts = stored(post.join(weighed, ["domain", "term"]).join(of, keys).select("domain", "term", "block", *(k for k in keys if k != "domain"), impact.alias("impact")))
        maxima = stored(impacts.groupBy("domain", "term", "block").agg(F.max("impact").alias("most"), F.count("*").alias("rows")))
        return cls(keys, impacts, maxima)

    def top(self, asked: DataFrame, query_keys: list[str], k: int, stored, score: Column | None = None, slack: float = 1e-9, first: int = FIRST) -> tuple[DataFrame, dict[str, int]]:
        """(query_keys, domain, keys, lexical, score, rank up to k; how many rows of postings were joined, and how many match a query's terms).

        asked: query_keys, domain, term, qtf. score: what to rank by, of column lexical, where it is not that itself; it may be
        off by `slack`. Ties go to the lesser keys.
        """
        group, rest = [*query_keys, "domain"], [c for c in self.keys if c != "domain"]
        met = asked.join(self.maxima, ["domain", "term"]).select(*group, "term", "block", "qtf", (F.col("qtf") * F.col("most")).alias("up"), "rows")
        bounds = met.groupBy(*group, "block").agg(F.sum("up").alias("bound"), F.sum("rows").alias("rows"))
        order = Window.partitionBy(*group).orderBy(F.desc("bound"), "block")
        bounds = stored(bounds.withColumn("place", F.row_number().over(order)))
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), *rest))
        best = lambda sums: sums.where("lexical > 0").withColumn("score", F.col("lexical") if score is None else score).withColumn("rank", rank).where(F.col("rank") <= k)
        impacts = self.impacts

        def added(terms: DataFrame) -> DataFrame:
            """What the postings of terms (group, term, block, qtf) add to documents."""
            return terms.join(impacts, ["domain", "term", "block"]).groupBy(*group, "block", *rest).agg(F.sum(F.col("qtf") * F.col("impact")).alias("lexical"), F.count("*").alias("joined"))

        begun = stored(added(asked.join(bounds.where(F.col("place") <= first).select(*group, "block"), group)))
        top = stored(best(begun.drop("block", "joined")))
        least = top.groupBy(*group).agg(F.count("*").alias("n"), F.min("score").alias("least"))
        # Where k are not found yet, everything is wanted.
        wanted = F.when(F.col("n") >= k, F.col("least") - slack).otherwise(F.lit(float("-inf")))
        left = bounds.where(F.col("place") > first).join(least, group, "left").withColumn("least", wanted).where(F.col("bound") >= F.col("least"))
        upto = F.sum("up").over(Window.partitionBy(*group, "block").orderBy("up", "term").rowsBetween(Window.unboundedPreceding, 0))
        terms = stored(met.join(left.select(*group, "block", "least"), [*group, "block"]).withColumn("essential", upto >= F.col("least")).withColumn("rest", F.sum(F.when(~F.col("essential"), F.col("up")).otherwise(0.0)).over(Window.partitionBy(*group, "block"))))
        limits = terms.groupBy(*group, "block").agg(F.first("least").alias("least"), F.first("rest").alias("rest"))
        named = stored(added(terms.where("essential").select(*group, "term", "block", "qtf")).join(limits, [*group, "block"]))
        candidates = named.where(F.col("lexical") + F.col("rest") >= F.col("least"))
        others = candidates.select(*group, "block", *rest).join(terms.where("NOT essential").select(*group, "term", "block", "qtf"), [*group, "block"])
        more = stored(others.join(impacts, ["domain", "term", "block", *rest]).groupBy(*group, *rest).agg(F.sum(F.col("qtf") * F.col("impact")).alias("more"), F.count("*").alias("joined")))
        whole = candidates.select(*group, *rest, "lexical").join(more.drop("joined"), [*group, *rest], "left").withColumn("lexical", F.col("lexical") + F.coalesce("more", F.lit(0.0))).drop("more")
        every = top.drop("rank").unionByName(best(whole).drop("rank"))
        joined = begun.select("joined").unionByName(named.select("joined")).unionByName(more.select("joined")).agg(F.coalesce(F.sum("joined"), F.lit(0))).first()[0]
        matching = bounds.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        return every.withColumn("rank", rank).where(F.col("rank") <= k), {"joined": joined, "matching": matching}


class _Block:
    """One block against a batch of questions: the words it holds, who asks them, and what they add at most."""

    def __init__(self, docs: pa.StructArray, asked: Asked, idf: np.ndarray, mean: float):
        doc, length, at, tf = docs.flatten()
        sizes, word, often = at.value_lengths().to_numpy(), at.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy()
        self.doc, of = doc.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        impact = idf[word] * often * (K1 + 1) / (often + K1 * (1 - B + B * length.to_numpy()[of] / mean))
        order = np.argsort(word, kind="stable")
        self.of, self.impact, word = of[order], impact[order], word[order]
        self.starts = np.flatnonzero(np.diff(word, prepend=-1))
        self.many = np.diff(self.starts, append=len(word))
        self.place, entry = asked.met(word[self.starts])
        self.item, self.qtf = asked.item[entry], asked.qtf[entry]
        self.up = self.qtf * np.maximum.reduceat(self.impact, self.starts)[self.place] if len(word) else np.zeros(0)
        self.bound = np.bincount(self.item, self.up, len(asked.items))
        self.rows = self.many[self.place]

    def pairs(self, entries: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question x document, what is added) of the postings of these entries; questions by their place in `among`."""
        many = self.rows[entries]
        one = np.repeat(entries, many)
        posting = np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many) + self.starts[self.place[one]]
        return among[self.item[one]] * len(self.doc) + self.of[posting], self.qtf[one] * self.impact[posting]

    def scored(self, wanted: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(question, doc, score; postings read) of the documents that can reach what the live questions want."""
        among = np.cumsum(live) - 1
        entries = np.flatnonzero(live[self.item])
        entries = entries[np.lexsort((self.place[entries], self.up[entries], self.item[entries]))]
        up, item = self.up[entries], self.item[entries]
        summed, first = np.cumsum(up), np.flatnonzero(np.diff(item, prepend=-1))
        upto = summed - np.repeat((summed - up)[first], np.diff(first, append=len(item)))
        essential = upto >= wanted[item] - 1e-9
        rest = np.bincount(item[~essential], up[~essential], len(live))[live]
        cells = int(live.sum()) * len(self.doc)
        cell, adds = self.pairs(entries[essential], among)
        score, read = np.bincount(cell, adds, cells), len(cell)
        near = (score > 0) & (score + np.repeat(rest, len(self.doc)) >= np.repeat(wanted[live], len(self.doc)) - 1e-9)
        cell, adds = self.pairs(entries[~essential], among)
        good = near[cell]
        score += np.bincount(cell[good], adds[good], cells)
        hit = np.flatnonzero(near)
        return np.flatnonzero(live)[hit // len(self.doc)], self.doc[hit % len(self.doc)], score[hit], read + int(good.sum())


def best_by_blocks(counts: DataFrame, asked: Asked, key: StructField, k: int, digits: int, stored: Callable[[DataFrame], DataFrame], block: int = BLOCK, first: int = FIRST) -> tuple[DataFrame, dict[str, int]]:
    """(key, domain, doc_id, lexical of those that can be among the first k; how many rows of postings were read, and how many match a question's words)."""
    spark, kind = counts.sparkSession, to_arrow_type(key.dataType)
    weighed = weights(counts, asked)
    shared = spark.sparkContext.broadcast((asked, weighed))
    docs = _blocks(counts, ["domain", "doc_id"], block).where("size(at) > 0")
    blocks = stored(docs.groupBy("domain", "block").agg(F.collect_list(F.struct("doc_id", "len", "at", "tf")).alias("docs")))

    def each(batch: pa.RecordBatch) -> Iterator[tuple[int, str, _Block]]:
        asked, weighed = shared.value
        domains, held = batch.column("domain").to_pylist(), batch.column("docs")
        for i, d in enumerate(domains):
            yield i, d, _Block(held[i].values, asked, *weighed[d])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The most promising blocks of each question among those of a task."""
        size = len(shared.value[0].items)
        most = {d: (np.full((first, size), -1.0), np.full((first, size), "", object)) for d in shared.value[1]}
        for batch in batches:
            names = batch.column("block").to_pylist()
            for i, d, b in each(batch):
                bound, name = most[d]
                least = bound.argmin(0)
                better = np.flatnonzero((b.bound > 0) & (b.bound > bound[least, np.arange(size)]))
                bound[least[better], better], name[least[better], better] = b.bound[better], names[i]
        for d, (bound, name) in most.items():
            place, item = np.nonzero(bound > 0)
            yield pa.record_batch([pa.array(item, pa.int32()), pa.array([d] * len(item), pa.string()), pa.array(name[place, item].tolist(), pa.string()), pa.array(bound[place, item])], names=["item", "domain", "block", "bound"])

    def scores(least: dict[str, np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Of each block's first questions alone, before anything is known of what they want; of all others after."""
        wanted = spark.sparkContext.broadcast(least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size, read, matching = len(shared.value[0].items), 0, 0
            best = {d: Best(size, k, digits) for d in shared.value[1]}
            for batch in batches:
                firsts = batch.column("items").to_pylist()
                for i, d, b in each(batch):
                    live = np.zeros(size, bool)
                    live[firsts[i] or []] = True
                    least = np.full(size, -np.inf)
                    if wanted.value is not None:
                        least, matching = wanted.value[d], matching + int(b.rows.sum())
                        live = ~live & (b.bound >= least - 1e-9) & (b.bound > 0)
                    if live.any():
                        *found, more = b.scored(least, live)
                        best[d].add(*found)
                        read += more
            for d, held in best.items():
                item, doc, score = held.cut()
                yield pa.record_batch([pa.array(item, pa.int32()), pa.array([d] * len(item), pa.string()), pa.array(doc, pa.int64()), pa.array(score), pa.nulls(len(item), pa.int64()), pa.nulls(len(item), pa.int64())], names=["item", "domain", "doc_id", "lexical", "joined", "matching"])
            yield pa.record_batch([pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([read]), pa.array([matching])], names=["item", "domain", "doc_id", "lexical", "joined", "matching"])

        return run

    schema = "item int, domain string, doc_id long, lexical double, joined long, matching long"
    order = Window.partitionBy("item", "domain").orderBy(F.desc("bound"), "block")
    chosen = blocks.mapInArrow(bounds, "item int, domain string, block string, bound double").withColumn("n", F.row_number().over(order)).where(F.col("n") <= first)
    chosen = stored(chosen.groupBy("domain", "block").agg(F.collect_list("item").alias("items")))
    begun = stored(blocks.join(F.broadcast(chosen), ["domain", "block"]).select("domain", "docs", "items").mapInArrow(scores(None), schema))
    rank = F.row_number().over(Window.partitionBy("item", "domain").orderBy(F.desc("lexical")))
    least = {d: np.full(len(asked.items), -np.inf) for d in weighed}
    for r in begun.where("item IS NOT NULL").withColumn("n", rank).where(F.col("n") == k).select("item", "domain", "lexical").collect():  # a number a question and domain
        least[r.domain][r.item] = r.lexical - 2 * 10.0**-digits  # two scores may be as far apart and round alike, or the other way
    rest = stored(blocks.join(F.broadcast(chosen), ["domain", "block"], "left").select("domain", "docs", "items").mapInArrow(scores(least), schema))
    every = begun.unionByName(rest)
    told = every.agg(F.sum("joined"), F.sum("matching")).first()
    names = spark.sparkContext.broadcast(asked.items)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([names.value[i] for i in batch.column("item").to_pylist()], kind), *batch.columns[1:4]], names=[key.name, "domain", "doc_id", "lexical"])

    out = every.where("item IS NOT NULL").mapInArrow(named, f"`{key.name}` {key.dataType.simpleString()}, domain string, doc_id long, lexical double")
    return out, {"joined": told[0] or 0, "matching": told[1] or 0}
