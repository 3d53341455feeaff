"""Changes to the registry as new tables: adjudication, tasks, rule edits, and their audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a supervisor may do, and what a task is about.
APPROVE, NOTICE, PROSECUTE = "APPROVE_COMPLIANT", "ISSUE_COMPOUNDING_NOTICE", "REFER_FOR_PROSECUTION"
TASK_CATEGORY, TASK_NOTES = "Packaged Food / Retail", "Routine Market Surveillance Audit"
NO_OFFICER, NO_STORE = "Assigned officer not found.", "Store premises not found."


def supervisor_status(action: Column) -> Column:
    """Any action that is not known approves."""
    return F.when(action == NOTICE, "COMPOUNDED").when(action == PROSECUTE, "REFERRED_FOR_PROSECUTION").otherwise("APPROVED")


def _decided(inspections: DataFrame, actions: DataFrame, how: str) -> DataFrame:
    """Inspections beside the actions (inspection_id, action, notes, fee) on them, with the fee that then holds: only a notice changes it."""
    acted = actions.select("inspection_id", F.coalesce("action", F.lit(APPROVE)).alias("action"), F.coalesce("notes", F.lit("")).alias("notes"), F.col("fee").alias("new_fee"), F.lit(True).alias("acted"))
    joined = inspections.join(acted, "inspection_id", how)
    return joined.withColumn("fee", F.when(F.col("action") == NOTICE, F.coalesce("new_fee", "fee")).otherwise(F.col("fee")))


def adjudicate(inspections: DataFrame, actions: DataFrame) -> DataFrame:
    """Inspections with the actions put in; a null action approves, and a notice without a fee leaves the fee as it was."""
    status = F.when(F.col("acted"), supervisor_status(F.col("action"))).otherwise(F.col("supervisor_status"))
    return _decided(inspections, actions, "left").select("inspection_id", status.alias("supervisor_status"), "fee", F.col("notes").alias("supervisor_notes"))


def adjudication_audits(inspections: DataFrame, actions: DataFrame) -> DataFrame:
    """One audit row for each action on an inspection that there is."""
    details = F.to_json(F.struct("action", "notes", F.col("fee").cast("string").alias("compounding_fee")))
    return _decided(inspections, actions, "inner").select(
        F.lit("Supervisor").alias("officer_name"), F.concat(F.lit("SUPERVISOR_"), "action").alias("action"), F.lit("INSPECTION").alias("target_type"),
        F.col("inspection_number").alias("target_id"), details.alias("details"))


def assign(tasks: DataFrame, users: DataFrame, stores: DataFrame) -> DataFrame:
    """Inspection rows of tasks (task_id, store_id, officer_id, category, notes): assigned, still to be audited, with a number from the id's digest.

    A task for an officer or a store that there is not is an ``error`` and has nothing else. ``audit_details`` is what its audit row says.
    """
    number = F.concat(F.lit("TASK-"), F.upper(F.substring(F.sha2(F.col("task_id").cast("string"), 256), 1, 6)))
    known = tasks.join(users.select(F.col("user_id").alias("officer_id"), "full_name"), "officer_id", "left").join(stores.select("store_id", "store_name", F.lit(True).alias("is_store")), "store_id", "left")
    error = F.when(F.col("full_name").isNull(), NO_OFFICER).when(F.col("is_store").isNull(), NO_STORE)
    ok = lambda c, name: F.when(error.isNull(), c).alias(name)
    return known.select(
        "task_id", error.alias("error"), ok(number, "inspection_number"), ok(F.col("store_id"), "store_id"), ok(F.col("officer_id"), "officer_id"), ok(F.col("officer_id"), "assigned_to_id"),
        ok(F.coalesce("category", F.lit(TASK_CATEGORY)), "category"), ok(F.lit("PENDING_AUDIT"), "compliance_status"), ok(F.lit(0).cast("long"), "score_tenths"),
        ok(F.coalesce("notes", F.lit(TASK_NOTES)), "remarks"), ok(F.lit("ASSIGNED"), "supervisor_status"), ok(F.lit("INSPECTION_ASSIGNED"), "audit_action"),
        ok(F.to_json(F.struct(F.col("full_name").alias("assigned_to"), F.col("store_name").alias("store"))), "audit_details"))


def update_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules with changes (rule_code, severity, weight, is_active) put in; a null in a change leaves the value."""
    new = changes.select("rule_code", *(F.col(c).alias(f"new_{c}") for c in ("severity", "weight", "is_active")))
    return rules.join(new, "rule_code", "left").select("rule_code", *(F.coalesce(f"new_{c}", c).alias(c) for c in ("severity", "weight", "is_active")))


def rule_audits(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """One audit row for each change to a rule that there is; it tells what was asked."""
    asked = changes.join(rules.select("rule_code"), "rule_code")
    return asked.select(F.lit("Admin").alias("officer_name"), F.lit("RULE_UPDATED").alias("action"), F.lit("RULE").alias("target_type"), F.col("rule_code").alias("target_id"),
                        F.to_json(F.struct("severity", "weight", "is_active")).alias("details"))


def sync_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("status") == "SYNCED").alias("synced"))
