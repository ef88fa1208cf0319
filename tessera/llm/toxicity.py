"""Toxicity: a character n-gram linear classifier scaled by naive Bayes log-count ratios.

The model is fitted on the driver from a bounded sample of labelled texts: of
those of at most `fit_chars` characters the `fit_rows` whose least ids hash lowest.
Equal texts are one, toxic if any label says so, so the sample never depends on
partitions. Labels of rows whose crc32(doc_id) is divisible by 5 are never used.
Only ids, lengths and hashes of texts are shuffled to choose; scoring is one pass
over whole texts with the model's table (4 bytes for each of 2^20 hashed n-grams).

Defined cases: null and empty texts score as the intercept and no n-gram says;
without labels of both classes the score is the labelled share (0 without any);
a label row repeated or in conflict counts as toxic if any says so; null labels
and null ids are ignored in fitting; every row gets its own result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out, sliced, table
from tessera.llm.ngrams import NgramModel, fit_ngrams, sigmoid

#: Bound of the fitting sample: rows, and characters of any one of them.
FIT_ROWS, FIT_CHARS = 4000, 20_000


def fit_sample(docs: DataFrame, labels: DataFrame, column: str, extra: list[str], rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> list:
    """At most `rows` labelled texts of at most `chars` characters as (doc_id, label, text, *extra), in id order, on the driver."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra).where(F.length("text") <= chars).withColumn("tag", F.xxhash64("text"))
    fitting = texts.select("doc_id", "tag").join(known, "doc_id").groupBy("tag").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    chosen = fitting.orderBy(F.xxhash64("doc_id"), "doc_id", "tag").limit(rows)
    rest = [c for c in texts.columns if c not in ("doc_id", "tag", "text")]
    found = texts.join(F.broadcast(chosen), ["doc_id", "tag"]).groupBy("doc_id", "tag").agg(F.max("label").alias("label"), F.min(F.struct("text", *rest)).alias("row"))
    return found.orderBy("doc_id", "tag").select("doc_id", "label", "row.*").collect()


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> NgramModel:
    sample = fit_sample(docs, labels, "toxic", [], rows, chars)
    return fit_ngrams([r.text for r in sample], np.array([r.label for r in sample], float))


def score_toxicity(docs: DataFrame, model: NgramModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit=1 << 20):
            score = sigmoid(shared.value.margins(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
