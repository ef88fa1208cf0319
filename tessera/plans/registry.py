"""Registry of queries, the derived document table they share, and the same pieces as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.operators.index import postings
from tessera.sources.shared import Scratch, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2026-01-01"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the metadata of the corpus model, derived from its integers."""
    d = read(spark, sf_dir, "documents")
    source = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    d = d.select("doc_id", "text", "lang", "source", pick(L.DOMAINS, F.col("doc_id") % 3).alias("domain"), pick(tuple(L.AUTHORITY_WEIGHTS), source % 4).alias("authority"), (F.col("doc_id") % 4 + 1).alias("version_no"),
                 F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 730).cast("int")).alias("effective"), F.when(F.col("doc_id") % 10 == 7, F.col("doc_id") - 3).alias("supersedes"))
    return d


def document_postings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents without their text, postings by domain and document): every text is read and cut into words once."""
    d = documents(spark, sf_dir)
    post = postings(spread(d.select("domain", "doc_id", "text")), ["domain", "doc_id"])
    return d.drop("text"), Scratch(spark).table(post, "postings")


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def norm(c: str) -> str:
    return f"lower(trim(regexp_replace(strip_accents({c}), '\\s+', ' ', 'g')))"


def raw(c: str) -> str:
    return f"regexp_extract_all({norm(c)}, '[a-z0-9]+(?:[-''][a-z0-9]+)*')"


def stem(t: str) -> str:
    out = t
    for suffix, put in reversed((("ies", "y"), ("sses", ""), ("ing", ""), ("ed", ""), ("s", ""))):
        out = f"CASE WHEN ends_with({t}, '{suffix}') AND len({t}) > {len(suffix) + 2} THEN {t}[1:len({t}) - {len(suffix)}] || '{put}' ELSE {out} END"
    return out


def content(c: str) -> str:
    return f"list_filter({raw(c)}, lambda t: len(t) > 1 AND NOT list_contains({_list(L.STOPWORDS)}, t))"


def tok(c: str) -> str:
    return f"list_transform({content(c)}, lambda t: {stem('t')})"


def words(values) -> str:
    return _list(values)


DOCS = f"""docs AS (
  SELECT doc_id, text, lang, source, {_list(L.DOMAINS)}[(doc_id % 3 + 1)::INT] AS domain, {_list(L.AUTHORITY_WEIGHTS)}[(regexp_extract(source, '([0-9]+)', 1)::INT % 4 + 1)::INT] AS authority,
    doc_id % 4 + 1 AS version_no, (DATE '2024-01-01' + (doc_id % 730)::INT)::DATE AS effective, CASE WHEN doc_id % 10 = 7 THEN doc_id - 3 END AS supersedes FROM documents)"""
