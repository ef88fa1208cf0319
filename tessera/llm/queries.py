"""Queries of this subpackage, by name, and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bestfit import op13_best_fit
from tessera.llm.covertree import op4_embedding_near_dedup
from tessera.llm.fingerprints import op5_fingerprints
from tessera.llm.language import op6_language_id
from tessera.llm.mixing import OP7_SQL, op7_mixing
from tessera.llm.negatives import OP12_SQL, op12_hard_negatives
from tessera.llm.packing import op9_packing
from tessera.llm.quality import op8_quality
from tessera.llm.secrets import op3_secret_scan
from tessera.llm.simhash import op10_simhash
from tessera.llm.substrings import op2_substring_dedup
from tessera.llm.toxicity import op1_toxicity
from tessera.llm.trie import OP11_SQL, op11_prefix_trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_secret_scan": op3_secret_scan,
        "op4_embedding_near_dedup": op4_embedding_near_dedup,
        "op5_fingerprints": op5_fingerprints,
        "op6_language_id": op6_language_id,
        "op7_mixing": op7_mixing,
        "op8_quality": op8_quality,
        "op9_packing": op9_packing,
        "op10_simhash": op10_simhash,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_best_fit": op13_best_fit,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op12_hard_negatives": OP12_SQL}
