"""Quality classifier by co-training of a text view and a page-metadata view.

The text view is the n-gram classifier of `ngrams`; the metadata view sees no
words, only language, source, size and layout (lines, letter case, digits,
punctuation) in quantile bins under a logistic regression. Both start from the
labelled rows. In each round every view scores all unlabelled documents, in one
distributed pass, and its most confident ones of either class, PER_ROUND in all,
join the other view's training rows. At the end each view is calibrated (Platt)
on labelled rows kept out of its fitting, and a document's score is the mean of
the calibrated log-odds, as a probability.

The driver holds fit_rows labelled texts and PER_ROUND pseudo-labelled ones a round
and view, of at most FIT_CHARS characters each; rows whose crc32(doc_id) is
divisible by 5 are never learnt from, nor are unlabelled ones of them. Equal texts
count once. Scoring is one pass over whole texts.

Defined cases: null and empty texts score by their metadata and the text view's
intercept; null or unseen languages and sources fall in bins of their own; labels
of one class only give that share as score; every row gets its own result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, held_out, sliced, table
from tessera.llm.ngrams import NgramModel, batched, fit_logistic, fit_ngrams, sigmoid
from tessera.llm.textblocks import utf8, words
from tessera.llm.toxicity import FIT_CHARS, fit_sample

FIT_ROWS, ROUNDS, PER_ROUND = 2400, 2, 240
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 line end, 5 punctuation
for _b in range(0x21, 0x7F):
    _CLASS[_b] = 1 if chr(_b).islower() else 2 if chr(_b).isupper() else 3 if chr(_b).isdigit() else 5
_CLASS[0x0A] = 4


def layout(column: pa.Array) -> np.ndarray:
    """Numbers of a page without its words: a row per text."""
    raw, at = utf8(column)
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    kinds = np.bincount(owner * 6 + _CLASS[raw], minlength=6 * n).reshape(n, 6).astype(float)
    size, tokens = np.diff(at).astype(float), words(raw, at).counts.astype(float)
    share = kinds / np.maximum(size, 1)[:, None]
    return np.column_stack([np.log1p(size), np.log1p(tokens), np.log1p(kinds[:, 4]), size / np.maximum(tokens, 1), tokens / (kinds[:, 4] + 1), share[:, 1], share[:, 2], share[:, 3], share[:, 5]])


@dataclass
class PageModel:
    """Quantile bins of the layout and values of language and source, each with a weight."""

    cuts: list[np.ndarray]
    names: dict[tuple[str, str | None], int]
    weights: np.ndarray
    intercept: float

    def places(self, numbers: np.ndarray, named: list[tuple]) -> np.ndarray:
        """Active columns of each row; 0 for what was not seen."""
        out, base = [], 1
        for k, cut in enumerate(self.cuts):
            out.append(base + np.searchsorted(cut, numbers[:, k], "right"))
            base += len(cut) + 1
        for k, kind in enumerate(("lang", "source")):
            out.append(np.array([self.names.get((kind, row[k]), -base) + base for row in named], np.int64))
        return np.column_stack(out)

    def margins(self, numbers: np.ndarray, named: list[tuple]) -> np.ndarray:
        return self.weights[self.places(numbers, named)].sum(1) + self.intercept if len(numbers) else np.zeros(0)


def fit_page(numbers: np.ndarray, named: list[tuple], target: np.ndarray, bins: int = 12) -> PageModel:
    cuts = [np.unique(np.quantile(numbers[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(numbers.shape[1])]
    seen = sorted({("lang", r[0]) for r in named} | {("source", r[1]) for r in named}, key=lambda x: (x[0], x[1] is not None, x[1] or ""))
    model = PageModel(cuts, {name: k for k, name in enumerate(seen)}, np.zeros(1), 0.0)
    places = model.places(numbers, named)
    width = 1 + sum(len(c) + 1 for c in cuts) + len(seen)
    row = np.repeat(np.arange(len(places)), places.shape[1])
    model.weights, model.intercept = fit_logistic(row, places.ravel(), np.ones(places.size), target, width, penalty=3e-3, rounds=200)
    model.weights[0] = 0.0
    return model


def platt(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make margins into log-odds on rows the view was not fitted on."""
    scale = max(1e-9, float(np.std(margin)))
    row = np.arange(len(margin))
    w, b = fit_logistic(row, np.zeros(len(margin), np.int64), margin / scale, target, 1, penalty=1e-3, rounds=400)
    return max(0.0, float(w[0]) / scale), b


@dataclass
class CoTrained:
    text: NgramModel
    page: PageModel
    text_scale: tuple[float, float]
    page_scale: tuple[float, float]

    def scores(self, column: pa.Array, named: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, text view, metadata view) of each row as probabilities."""
        a = self.text_scale[0] * self.text.margins(column) + self.text_scale[1]
        b = self.page_scale[0] * self.page.margins(layout(column), named) + self.page_scale[1]
        return sigmoid((a + b) / 2), sigmoid(a), sigmoid(b)


#: Gives the rows (text, lang, source, label) that the text view is sure of, and those that the metadata view is sure of.
Search = Callable[[NgramModel, PageModel, float], tuple[list, list]]


def co_train(labelled: list, search: Search | None = None, rounds: int = ROUNDS) -> CoTrained:
    """Fit on rows of (text, lang, source, label) and what `search` finds in each round."""
    target = np.array([r.label for r in labelled], float)
    if not len(target) or target.min() == target.max():
        flat = fit_ngrams([], target) if not len(target) else fit_ngrams([r.text for r in labelled], target)
        return CoTrained(flat, PageModel([], {}, np.zeros(1), 0.0), (2.0, 0.0), (0.0, 0.0))
    held, learnt = labelled[::5], [r for k, r in enumerate(labelled) if k % 5]
    of_text, of_page = list(learnt), list(learnt)
    layouts = lambda rows: np.concatenate([layout(c) for _, c in batched([r.text for r in rows])])
    labels = lambda rows: np.array([r.label for r in rows], float)
    names = lambda rows: [(r.lang, r.source) for r in rows]

    def fitted() -> tuple[NgramModel, PageModel]:
        return fit_ngrams([r.text for r in of_text], labels(of_text), features=15_000), fit_page(layouts(of_page), names(of_page), labels(of_page))

    for _ in range(rounds if search else 0):
        sure_by_text, sure_by_page = search(*fitted(), float(target.mean()))
        if not sure_by_text and not sure_by_page:
            break
        of_page += sure_by_text
        of_text += sure_by_page
    text, page = fitted()
    t_margin = np.concatenate([text.margins(c) for _, c in batched([r.text for r in held])])
    return CoTrained(text, page, platt(t_margin, labels(held)), platt(page.margins(layouts(held), names(held)), labels(held)))


def _margins(docs: DataFrame, text: NgramModel, page: PageModel) -> DataFrame:
    """(doc_id, tag, by_text, by_page) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((text, page))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, layout_ = shared.value
        for batch in sliced(batches, limit=1 << 20):
            column = batch.column("text")
            named = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            yield pa.record_batch([batch.column("doc_id"), batch.column("tag"), pa.array(words_.margins(column)), pa.array(layout_.margins(layout(column), named))], names=["doc_id", "tag", "by_text", "by_page"])

    return docs.select("doc_id", "tag", "text", "lang", "source").mapInArrow(run, "doc_id long, tag long, by_text double, by_page double")


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> CoTrained:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    meta = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    labelled = fit_sample(docs, labels, "quality", meta, fit_rows, FIT_CHARS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *meta).withColumn("tag", F.xxhash64("text"))
    texts = texts.where(F.col("doc_id").isNotNull() & ~held_out("doc_id") & (F.length("text") <= FIT_CHARS))
    known = labels.where("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    taken: list[int] = []

    def search(text: NgramModel, page: PageModel, share: float) -> tuple[list, list]:
        every = _margins(texts, text, page).join(known, "doc_id", "left_anti").groupBy("tag").agg(F.min(F.struct("doc_id", "by_text", "by_page")).alias("m")).select("tag", "m.*")
        used = spark.createDataFrame([(t,) for t in taken], "tag long")
        free = scratch.table(every.join(F.broadcast(used), "tag", "left_anti"), f"margins{len(taken)}")
        few, many = max(1, int(per_round * share)), max(1, int(per_round * (1 - share)))
        picks = []
        for view in ("by_text", "by_page"):
            low = free.where(F.col(view) < 0).orderBy(view, "tag").limit(many).withColumn("label", F.lit(0))
            high = free.where(F.col(view) > 0).orderBy(F.desc(view), "tag").limit(few).withColumn("label", F.lit(1))
            picks.append(low.unionByName(high).select("doc_id", "tag", "label").withColumn("view", F.lit(view)))
        chosen = scratch.table(picks[0].unionByName(picks[1]), f"chosen{len(taken)}")
        found = texts.join(F.broadcast(chosen), ["doc_id", "tag"]).groupBy("view", "doc_id", "tag").agg(F.min("label").alias("label"), F.min(F.struct("text", "lang", "source")).alias("row"))
        rows = found.orderBy("doc_id", "tag").select("view", "tag", "label", "row.*").collect()
        taken.extend(sorted({r.tag for r in rows}))
        return [r for r in rows if r.view == "by_text"], [r for r in rows if r.view == "by_page"]

    return co_train(labelled, search, rounds)


def score_quality(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, held_out, score, predicted, text_score, meta_score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit=1 << 20):
            named = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            score, text, page = shared.value.scores(batch.column("text"), named)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(text), pa.array(page)], names=["doc_id", "held_out", "score", "predicted", "text_score", "meta_score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, text_score double, meta_score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
