"""Queries that give the tables a change leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import workflow
from shelfmark.sources import dimensions
from shelfmark.sources import registry_views as views
from shelfmark.sources.tables import table


def actions(spark: SparkSession, d: str) -> DataFrame:
    """What supervisors did, from events whose value is an inspection's: the latest of each inspection."""
    k = F.col("inspection_id")
    action = F.when(k % 5 == 0, workflow.NOTICE).when(k % 5 == 1, workflow.PROSECUTE).when(k % 5 == 2, workflow.APPROVE).when(k % 5 == 3, "SOMETHING")
    return views.inspections(spark, d).where(k % 7 != 0).select(
        "inspection_id", action.alias("action"), F.when(k % 3 == 0, "seen").alias("notes"), F.when(k % 2 == 0, F.lit(2500)).cast("decimal(18,2)").alias("fee"))


ACTIONS_SQL = {"v_actions": """SELECT o_orderkey AS inspection_id, coalesce(CASE o_orderkey % 5 WHEN 0 THEN 'ISSUE_COMPOUNDING_NOTICE' WHEN 1 THEN 'REFER_FOR_PROSECUTION' WHEN 2 THEN 'APPROVE_COMPLIANT' WHEN 3 THEN 'SOMETHING' END, 'APPROVE_COMPLIANT') AS action,
    CASE WHEN o_orderkey % 3 = 0 THEN 'seen' ELSE '' END AS notes, CASE WHEN o_orderkey % 2 = 0 THEN CAST(2500 AS DECIMAL(18,2)) END AS fee FROM orders WHERE o_orderkey % 7 <> 0"""}
_FEE = "CASE WHEN a.action = 'ISSUE_COMPOUNDING_NOTICE' THEN coalesce(a.fee, i.fee) ELSE i.fee END"


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("task_id"), (k % 12).alias("store_id"), F.when(k % 10 != 0, F.col("o_custkey")).alias("officer_id"),
                                            F.when(k % 2 == 0, "Food").alias("category"), F.when(k % 3 == 0, "look again").alias("notes"))


def _rules(spark: SparkSession) -> DataFrame:
    return dimensions.rules(spark).select("rule_code", "severity", F.lit(10).cast("long").alias("weight"), F.lit(True).alias("is_active"))


def rule_changes(spark: SparkSession, d: str) -> DataFrame:
    """Partial changes to rules, each an event: rule_code, changed_at, change_id, severity, weight, is_active. Some are to rules that there are not."""
    k = F.col("event_id")
    return table(spark, d, "events").select(
        F.concat(F.lit("LM-PC-"), F.lpad((k % 13 + 1).cast("string"), 3, "0")).alias("rule_code"), F.col("ts").alias("changed_at"), k.alias("change_id"),
        F.when(k % 3 == 0, F.element_at(F.array(*map(F.lit, ("HIGH", "MEDIUM", "CRITICAL", "LOW"))), (k % 4 + 1).cast("int"))).alias("severity"),
        F.when(k % 4 == 0, k % 50).alias("weight"), F.when(k % 5 == 0, k % 2 == 0).alias("is_active"))


RULE_CHANGES_SQL = """SELECT 'LM-PC-' || lpad(CAST(event_id % 13 + 1 AS VARCHAR), 3, '0') AS rule_code, ts AS changed_at, event_id AS change_id,
    CASE WHEN event_id % 3 = 0 THEN (['HIGH', 'MEDIUM', 'CRITICAL', 'LOW'])[CAST(event_id % 4 + 1 AS INTEGER)] END AS severity, CASE WHEN event_id % 4 = 0 THEN event_id % 50 END AS weight,
    CASE WHEN event_id % 5 = 0 THEN event_id % 2 = 0 END AS is_active FROM events"""


def _last(spark: SparkSession, d: str) -> DataFrame:
    """Of the changes, the last value of each column."""
    order = F.struct("changed_at", "change_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return rule_changes(spark, d).groupBy("rule_code").agg(last("severity"), last("weight"), last("is_active"))


QUERIES = {
    "q_adjudicate": lambda spark, d: workflow.adjudicate(views.inspections(spark, d), actions(spark, d)),
    "q_assign": lambda spark, d: workflow.assign(_tasks(spark, d), views.users(spark, d), views.stores(spark, d)),
    "q_rule_update": lambda spark, d: workflow.update_rules(_rules(spark), _last(spark, d)),
    "q_audit_rows": lambda spark, d: workflow.adjudication_audits(views.inspections(spark, d), actions(spark, d)),
    "q_rule_audits": lambda spark, d: workflow.rule_audits(_rules(spark), rule_changes(spark, d)),
}

_RULE_LAST = "SELECT rule_code, " + ", ".join(f"arg_max({c}, row(changed_at, change_id)) FILTER ({c} IS NOT NULL) AS {c}" for c in ("severity", "weight", "is_active")) + f" FROM ({RULE_CHANGES_SQL}) GROUP BY 1"
ORACLES = {
    "q_adjudicate": views.with_views(f"""SELECT i.inspection_id, CASE WHEN a.inspection_id IS NULL THEN i.supervisor_status WHEN a.action = 'ISSUE_COMPOUNDING_NOTICE' THEN 'COMPOUNDED'
        WHEN a.action = 'REFER_FOR_PROSECUTION' THEN 'REFERRED_FOR_PROSECUTION' ELSE 'APPROVED' END AS supervisor_status, {_FEE} AS fee, a.notes AS supervisor_notes
        FROM v_inspections i LEFT JOIN v_actions a ON a.inspection_id = i.inspection_id""", ACTIONS_SQL),
    "q_assign": views.with_views("""SELECT task_id, error, CASE WHEN error IS NULL THEN number END AS inspection_number, CASE WHEN error IS NULL THEN store_id END AS store_id, CASE WHEN error IS NULL THEN officer_id END AS officer_id,
        CASE WHEN error IS NULL THEN officer_id END AS assigned_to_id, CASE WHEN error IS NULL THEN category END AS category, CASE WHEN error IS NULL THEN 'PENDING_AUDIT' END AS compliance_status,
        CASE WHEN error IS NULL THEN CAST(0 AS BIGINT) END AS score_tenths, CASE WHEN error IS NULL THEN notes END AS remarks, CASE WHEN error IS NULL THEN 'ASSIGNED' END AS supervisor_status,
        CASE WHEN error IS NULL THEN 'INSPECTION_ASSIGNED' END AS audit_action, CASE WHEN error IS NULL THEN '{"assigned_to":"' || full_name || '","store":"' || store_name || '"}' END AS audit_details
        FROM (SELECT o_orderkey AS task_id, 'TASK-' || upper(substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 6)) AS number, s.store_id, s.store_name, u.user_id AS officer_id, u.full_name,
        CASE WHEN o_orderkey % 2 = 0 THEN 'Food' ELSE 'Packaged Food / Retail' END AS category, CASE WHEN o_orderkey % 3 = 0 THEN 'look again' ELSE 'Routine Market Surveillance Audit' END AS notes,
        CASE WHEN u.user_id IS NULL THEN 'Assigned officer not found.' WHEN s.store_id IS NULL THEN 'Store premises not found.' END AS error FROM orders
        LEFT JOIN v_users u ON o_orderkey % 10 <> 0 AND u.user_id = o_custkey LEFT JOIN v_stores s ON s.store_id = o_orderkey % 12)"""),
    "q_rule_update": f"""SELECT r.rule_code, coalesce(c.severity, r.severity) AS severity, coalesce(c.weight, 10) AS weight, coalesce(c.is_active, TRUE) AS is_active
        FROM ({dimensions.RULES_SQL}) r LEFT JOIN ({_RULE_LAST}) c ON c.rule_code = r.rule_code""",
    "q_audit_rows": views.with_views(f"""SELECT 'Supervisor' AS officer_name, 'SUPERVISOR_' || a.action AS action, 'INSPECTION' AS target_type, i.inspection_number AS target_id,
        '{{"action":"' || a.action || '","notes":"' || a.notes || '","compounding_fee":"' || CAST({_FEE} AS VARCHAR) || '"}}' AS details FROM v_inspections i JOIN v_actions a ON a.inspection_id = i.inspection_id""", ACTIONS_SQL),
    "q_rule_audits": f"""SELECT 'Admin' AS officer_name, 'RULE_UPDATED' AS action, 'RULE' AS target_type, c.rule_code AS target_id, '{{' || concat_ws(',', '"severity":"' || c.severity || '"', '"weight":' || c.weight, '"is_active":' || c.is_active) || '}}' AS details
        FROM ({RULE_CHANGES_SQL}) c JOIN ({dimensions.RULES_SQL}) r ON r.rule_code = c.rule_code""",
}
