"""Every query of the library by name, and its DuckDB oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.plans import creation_queries, fusion_queries, ledger_queries, registry_queries, report_queries, rule_queries, spatial_queries, summary_queries, text_queries, workflow_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for part in (summary_queries, registry_queries, text_queries, rule_queries, spatial_queries, fusion_queries, workflow_queries, creation_queries, ledger_queries, report_queries):
    QUERIES.update(part.QUERIES)
    ORACLES.update(part.ORACLES)
