"""All queries of the core and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.plans import contracts, documents, drift, more, rankings, runs, schedule, sources, summary, symbols, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p5_found": drift.p5_found,
    "p5_changes": drift.p5_changes,
    "p5_unified": drift.p5_unified,
    "p5_lines": drift.p5_lines,
    "p5_lost": drift.p5_lost,
    **documents.QUERIES,
    **contracts.QUERIES,
    **rankings.QUERIES,
    **runs.QUERIES,
    **sources.QUERIES,
    **more.QUERIES,
    **schedule.QUERIES,
    **texts.QUERIES,
    **summary.QUERIES,
    **symbols.QUERIES,
}
SQL: dict[str, str] = {**drift.SQL, **documents.SQL, **contracts.SQL, **rankings.SQL, **runs.SQL, **sources.SQL, **more.SQL, **schedule.SQL, **texts.SQL, **summary.SQL, **symbols.SQL}
