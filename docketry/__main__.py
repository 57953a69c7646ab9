"""Commands: ``python -m docketry COMMAND DIR [ARGUMENTS]`` prints rows as JSON lines.

``DIR`` holds the tables. Exit codes: 0 done, 1 failed, 2 nothing of that name or nothing found.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import facts, linkage, search, segments
from docketry.plans import catalog, indexes
from docketry.session import local_session
from docketry.sources.tables import table


def boundary(text: str | None) -> str | None:
    """A day as YYYY-MM-DD from any ISO form; raises for any other."""
    try:
        return None if text is None else date.fromisoformat(text).isoformat()
    except ValueError:
        raise ValueError(f"not a date like YYYY-MM-DD: {text!r}") from None


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence_facts", "fact_id", "evidence_id", "artifact_id", "fact_type", "raw_text", "normalized_text", "numeric_value").distinct()


def _dates(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    start, end = boundary(a.start), boundary(a.end)
    if start and end and start > end:
        raise ValueError("start must not be after end")
    return facts.dates_between(_facts(spark, a.dir), start, end, a.limit)


def _lookup(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return catalog.queries()["native_snippets"](spark, a.dir).where(F.col("native_identifier") == a.value).orderBy("evidence_id")


def _trace(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return catalog.queries()["observation_trace"](spark, a.dir).where(F.col("observation_id") == a.value).orderBy("evidence_id")


#: Commands with arguments of their own; every query is a command, too.
COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], DataFrame]] = {
    "search": lambda s, a: search.search(indexes.index(s, a.dir), a.value or "", a.limit),
    "amounts": lambda s, a: facts.money_between(_facts(s, a.dir), a.min, a.max, a.limit),
    "dates": _dates,
    "identifier": lambda s, a: facts.with_identifier(_facts(s, a.dir), a.value or "", a.limit),
    "segment-anchor": lambda s, a: segments.with_anchor(indexes.distinct_segments(s, a.dir), a.value or "", a.limit),
    "lookup": _lookup,
    "trace": _trace,
    "references": lambda s, a: linkage.references(indexes.preferred_text(s, a.dir), "extracted_text"),
}
#: Names of the commands that are queries (fixed values).
ALIASES = {
    "status": "status_counts", "changes": "watch_changes", "review": "review_queue", "repeated-segments": "repeated_segments", "near-segments": "family_near_duplicates", "recurrence-clusters": "cluster_statistics", "recurrence-packets": "recurrence_packets",
    "analyze-candidates": "recurrence_variation", "analyze-versions": "version_observations", "analyze-watch-changes": "watch_observations", "package-leads": "packaged_leads", "lead": "current_status", "review-lead": "checked_events", "evaluate": "retrieval_metrics",
    "benchmark": "benchmark_pool", "curate": "curated_benchmark", "report": "scorable_report", "ingest": "ingested_files", "extract": "extracted_facts", "segment": "cut_segments", "index": "term_document_frequency", "watch": "visit_outcomes", "discover": "agenda_resources",
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    p = argparse.ArgumentParser(prog="docketry")
    p.add_argument("command")
    p.add_argument("dir")
    p.add_argument("value", nargs="?")
    p.add_argument("--min", type=float)
    p.add_argument("--max", type=float)
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--limit", type=int, default=20)
    a = p.parse_args(argv)
    out = out or sys.stdout
    queries = catalog.queries()
    run = COMMANDS.get(a.command)
    name = ALIASES.get(a.command, a.command)
    if run is None and name not in queries:
        print(f"unknown command: {a.command}", file=sys.stderr)
        return 2
    spark = spark or local_session()
    try:
        rows = (run(spark, a) if run else queries[name](spark, a.dir)).toJSON().toLocalIterator()
        found = 0
        for found, row in enumerate(rows, 1):  # noqa: B007 - counts
            print(json.dumps(json.loads(row), ensure_ascii=False, sort_keys=True), file=out)
    except Exception as e:  # a command reports and ends
        print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return 1
    return 0 if found or a.command not in ("trace", "lookup", "identifier", "search") else 2


if __name__ == "__main__":
    sys.exit(main())
