"""Queries over registries that are written, changed and read again in the shared folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import payloads, versions, workflow
from shelfmark.operators.ledger import Ledger
from shelfmark.operators.registration import register
from shelfmark.plans import workflow_queries
from shelfmark.plans.creation_queries import _CREATABLE, created_sql
from shelfmark.sources import dimensions
from shelfmark.sources import registry_views as views
from shelfmark.sources import submissions as sent
from shelfmark.sources.shared import shared_path

AT = datetime(1997, 1, 1)  # amid the orders' dates


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def registered(spark: SparkSession, d: str) -> Ledger:
    """All submissions that can be created, in two batches, the second of which is tried twice.

    Submissions and their declarations are written once, as every table of both batches reads them; the errors are among
    what is written, so that the filter reads them and doesn't find them again.
    """
    root = shared_path(spark, "registry")
    ledger = Ledger(spark, root)
    checked = _stored(payloads.checked(sent.submissions(spark, d)), f"{root}/_sent/submissions").where("error IS NULL")
    entries = _stored(payloads.declared(payloads.entries(checked)), f"{root}/_sent/declared").withColumnRenamed("offline_id", "image_id")
    for batch, half in (("0001", F.col("image_id") % 2 == 0), ("0002", F.col("image_id") % 2 == 1), ("0002", F.lit(True))):
        requests = checked.withColumnRenamed("offline_id", "image_id").where(half)
        register(ledger, batch, requests.drop("payload", "error"), entries.where(half), views.stores(spark, d), views.users(spark, d), dimensions.rules(spark))
    return ledger


def _registered(spark: SparkSession, d: str) -> DataFrame:
    """Each inspection with how many children refer to it, and the children's ids; a child without an inspection would be a row without a number."""
    ledger = registered(spark, d)
    per = lambda table, key, name: ledger.read(table).groupBy("inspection_id").agg(F.count(F.lit(1)).alias(f"n_{table}"), F.min(key).alias(f"first_{name}"), F.max(key).alias(f"last_{name}"))
    rows = ledger.read("inspections").select("inspection_id", "inspection_number", "store_id", "score_tenths", "remarks")
    for child in (per("declarations", "declaration_id", "declaration"), per("violations", "violation_id", "violation"), per("audits", "audit_id", "audit")):
        rows = rows.join(child, "inspection_id", "full")
    stores = ledger.read("stores").select("store_id", F.col("store_name").alias("new_store"))
    return rows.join(stores, "store_id", "left")


def inspection_log(spark: SparkSession, d: str) -> Ledger:
    """Inspections as they came, their adjudications five days later, and an officer's verification of a third of them after eight days."""
    ledger = Ledger(spark, shared_path(spark, "versions"))
    came = views.inspections(spark, d)
    later = lambda days: F.col("created_at") + F.expr(f"INTERVAL {days} DAYS")
    none = lambda kind: F.lit(None).cast(kind)
    versions.append(ledger, "0001", "inspection_log", came.select(
        "inspection_id", F.col("created_at").alias("changed_at"), F.lit(1).cast("long").alias("change_id"), "supervisor_status", "fee", none("string").alias("supervisor_notes"),
        "compliance_status", "score_tenths", F.lit(False).alias("officer_verified")))
    decided = versions.adjudicated(came, workflow.adjudicate(came, workflow_queries.actions(spark, d)), later(5))
    versions.append(ledger, "0002", "inspection_log", decided.select("*", none("string").alias("compliance_status"), none("long").alias("score_tenths"), none("boolean").alias("officer_verified")))
    k = F.col("inspection_id")
    versions.append(ledger, "0003", "inspection_log", came.where(k % 3 == 1).select(
        "inspection_id", later(8).alias("changed_at"), F.lit(3).cast("long").alias("change_id"), none("string").alias("supervisor_status"), F.when(k % 2 == 0, F.lit(100)).cast("decimal(18,2)").alias("fee"),
        none("string").alias("supervisor_notes"), F.lit("COMPLIANT").alias("compliance_status"), (k * 7 % 1001).alias("score_tenths"), F.lit(True).alias("officer_verified")))
    return ledger


def _snapshot(spark: SparkSession, d: str, at: datetime | None, compact_at: datetime | None = None) -> DataFrame:
    ledger = inspection_log(spark, d)
    if compact_at is not None:
        versions.compact(ledger, "0004", "inspection_log", "inspection_id", compact_at)
    return versions.as_of(ledger.read("inspection_log"), "inspection_id", at)


def _rule_log(spark: SparkSession, d: str) -> DataFrame:
    """The rules as they were at a time, from a log of partial changes."""
    ledger = Ledger(spark, shared_path(spark, "rules"))
    seeds = dimensions.rules(spark).select("rule_code", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz").alias("changed_at"), F.lit(-1).cast("long").alias("change_id"), "severity", F.lit(10).cast("long").alias("weight"), F.lit(True).alias("is_active"))
    versions.append(ledger, "0001", "rule_log", seeds)
    changes = workflow_queries.rule_changes(spark, d)
    versions.append(ledger, "0002", "rule_log", changes.join(seeds.select("rule_code"), "rule_code", "left_semi").select(seeds.columns))
    return versions.as_of(ledger.read("rule_log"), "rule_code", datetime(2024, 1, 15))


QUERIES = {
    "q_registered": _registered,
    "q_registry_snapshot": lambda spark, d: _snapshot(spark, d, None),
    "q_registry_as_of": lambda spark, d: _snapshot(spark, d, AT),
    "q_registry_compacted": lambda spark, d: _snapshot(spark, d, AT, AT),
    "q_rules_as_of": _rule_log,
}

_ORDERED = f"""SELECT r.image_id, row_number() OVER (ORDER BY r.image_id % 2, r.image_id) AS inspection_id, r.store_id, r.store_name, s.store_id AS known FROM v_requests r JOIN v_sent x ON x.offline_id = r.image_id AND x.error IS NULL
    LEFT JOIN v_stores s ON s.store_id = r.store_id"""
_REGISTERED = f"""WITH o AS ({_ORDERED}), n AS (SELECT image_id, (SELECT max(store_id) FROM v_stores) + row_number() OVER (ORDER BY inspection_id) AS store_id, coalesce(store_name, 'General Retail Store') AS new_store FROM o WHERE known IS NULL),
    f AS (SELECT f.*, o.inspection_id AS i, row_number() OVER (ORDER BY o.inspection_id, f.field_name) AS id FROM (SELECT f.* FROM {_CREATABLE}) f JOIN o ON o.image_id = f.image_id),
    g AS (SELECT i, count(*) AS n, min(id) AS a, max(id) AS b FROM f GROUP BY 1), v AS (SELECT o.inspection_id AS i, row_number() OVER (ORDER BY o.inspection_id, v.place) AS id FROM v_documents v JOIN o ON o.image_id = v.image_id),
    w AS (SELECT i, count(*) AS n, min(id) AS a, max(id) AS b FROM v GROUP BY 1)
    SELECT o.inspection_id, c.inspection_number, coalesce(n.store_id, o.known) AS store_id, c.score_tenths, 'AI-assisted field inspection screening.' AS remarks, g.n AS n_declarations, g.a AS first_declaration, g.b AS last_declaration,
    w.n AS n_violations, w.a AS first_violation, w.b AS last_violation, CAST(1 AS BIGINT) AS n_audits, o.inspection_id AS first_audit, o.inspection_id AS last_audit, n.new_store
    FROM o JOIN v_created c ON c.image_id = o.image_id LEFT JOIN n ON n.image_id = o.image_id LEFT JOIN g ON g.i = o.inspection_id LEFT JOIN w ON w.i = o.inspection_id"""


def _snapshot_sql(at: str | None) -> str:
    """Each inspection with what of its changes had come by then."""
    by = lambda days: "TRUE" if at is None else f"i.created_at + INTERVAL {days} DAYS <= TIMESTAMP '{at}'"
    acted, checked = f"(a.inspection_id IS NOT NULL AND {by(5)})", f"(i.inspection_id % 3 = 1 AND {by(8)})"
    fee = f"CASE WHEN {checked} AND i.inspection_id % 2 = 0 THEN CAST(100 AS DECIMAL(18,2)) WHEN {acted} AND a.action = 'ISSUE_COMPOUNDING_NOTICE' THEN coalesce(a.fee, i.fee) ELSE i.fee END"
    status = "CASE a.action WHEN 'ISSUE_COMPOUNDING_NOTICE' THEN 'COMPOUNDED' WHEN 'REFER_FOR_PROSECUTION' THEN 'REFERRED_FOR_PROSECUTION' ELSE 'APPROVED' END"
    return views.with_views(f"""SELECT i.inspection_id, CASE WHEN {checked} THEN i.created_at + INTERVAL 8 DAYS WHEN {acted} THEN i.created_at + INTERVAL 5 DAYS ELSE i.created_at END AS changed_at,
        CAST(CASE WHEN {checked} THEN 3 WHEN {acted} THEN 2 ELSE 1 END AS BIGINT) AS change_id, CASE WHEN {acted} THEN {status} ELSE i.supervisor_status END AS supervisor_status, {fee} AS fee,
        CASE WHEN {acted} THEN a.notes END AS supervisor_notes, CASE WHEN {checked} THEN 'COMPLIANT' ELSE i.compliance_status END AS compliance_status,
        CASE WHEN {checked} THEN i.inspection_id * 7 % 1001 ELSE i.score_tenths END AS score_tenths, {checked} AS officer_verified
        FROM v_inspections i LEFT JOIN v_actions a ON a.inspection_id = i.inspection_id WHERE {by(0)}""", workflow_queries.ACTIONS_SQL)


_RULES_AT = f"""WITH c AS (SELECT * FROM ({workflow_queries.RULE_CHANGES_SQL}) WHERE changed_at <= TIMESTAMP '2024-01-15 00:00:00'), l AS (SELECT rule_code, max(row(changed_at, change_id)) AS m,
    {", ".join(f"arg_max({c}, row(changed_at, change_id)) FILTER ({c} IS NOT NULL) AS {c}" for c in ("severity", "weight", "is_active"))} FROM c GROUP BY 1)
    SELECT r.rule_code, coalesce(t.changed_at, TIMESTAMP '1970-01-01 00:00:00') AS changed_at, coalesce(t.change_id, -1) AS change_id, coalesce(l.severity, r.severity) AS severity, coalesce(l.weight, 10) AS weight,
    coalesce(l.is_active, TRUE) AS is_active FROM ({dimensions.RULES_SQL}) r LEFT JOIN l ON l.rule_code = r.rule_code LEFT JOIN c t ON t.rule_code = l.rule_code AND row(t.changed_at, t.change_id) = l.m"""
ORACLES = {
    "q_registered": created_sql(_REGISTERED.replace("WITH o AS", "SELECT * FROM (WITH o AS", 1) + ")"),
    "q_registry_snapshot": _snapshot_sql(None),
    "q_registry_as_of": _snapshot_sql("1997-01-01 00:00:00"),
    "q_registry_compacted": _snapshot_sql("1997-01-01 00:00:00"),
    "q_rules_as_of": _RULES_AT,
}
