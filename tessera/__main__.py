"""python -m tessera CORPUS_DIR ["question" ...] [--demo] [--as-of DATE] [--expect DOMAIN ...] [--explain] [--stats].

Without questions, or with --demo, three demonstration questions are asked. Exit status 2 for an empty question.
"""

from __future__ import annotations

import argparse
import logging
import sys
from datetime import date

from tessera.functions.lexicons import DOMAINS

DEMO = (
    "How is a new service put into production, and which compliance reviews does that need?",
    "How can slow API calls be traced without breaking the rules for security?",
    "Who has to approve a new way of processing customer data?",
)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("corpus", help="folder of <domain>.jsonl files")
    parser.add_argument("questions", nargs="*")
    parser.add_argument("--demo", action="store_true", help="ask the demonstration questions")
    parser.add_argument("--as-of", default=date.today().isoformat())
    parser.add_argument("--expect", nargs="*", default=[], choices=DOMAINS, metavar="DOMAIN", help="the domains every question should be routed to, for the report of --stats")
    parser.add_argument("--explain", action="store_true", help="conflicts, citations and messages too")
    parser.add_argument("--stats", action="store_true", help="documents and passages by domain, and the report of this run")
    args = parser.parse_args(argv)
    questions = list(DEMO) if args.demo or not args.questions else args.questions
    if any(not q.strip() for q in questions):
        print("a question is empty", file=sys.stderr)
        return 2
    logging.basicConfig(level=logging.INFO, stream=sys.stderr)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tessera.operators.knowledge import stats
    from tessera.operators.monitoring import Registry
    from tessera.plans.engine import Engine
    from tessera.sources.corpus import load_corpus

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    engine = Engine(spark, load_corpus(spark, args.corpus))
    asked = spark.createDataFrame([(f"q{k + 1}", q) for k, q in enumerate(questions)], "trace_id string, query string")
    result = engine.answer(asked, args.as_of)
    for row in result.answers.orderBy("trace_id").collect():
        print(f"{row.query}\n\n{row.answer}\n")
    if args.explain:
        for df in (result.conflicts.drop("conflict_id"), result.audit, result.messages):
            df.show(50, truncate=80)
    if args.stats:
        stats(engine.documents, engine.passages).show()
        from tessera.sources.shared import Scratch

        registry = Registry(spark, f"{Scratch(spark).root}/records")
        result.record(registry, asked.select("trace_id", F.array(*map(F.lit, args.expect)).cast("array<string>").alias("expected")))
        print(registry.report())
    return 0


if __name__ == "__main__":
    sys.exit(main())
