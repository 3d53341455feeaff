"""Liability, repeat offenders and penalty memos, for all inspections at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_AMOUNT = 5000
# What an offence may cost.
FIRST_SCALE = "FIRST OFFENCE — Penalty up to ₹25,000 per violation under Section 36(1)"
REPEAT_SCALE = "SECOND / SUBSEQUENT OFFENCE — Penalty up to ₹50,000 / ₹1,00,000 or imprisonment under Section 36(1)"


def compounding(amount: Column) -> Column:
    """An amount that is null or zero counts as the default."""
    return F.coalesce(F.nullif(amount, F.lit(0)), F.lit(DEFAULT_AMOUNT)).cast("decimal(18,2)")


def repeat_offenders(inspections: DataFrame) -> DataFrame:
    """Whether another non-compliant inspection of the same store exists; inspections without a store count as one store.

    The counts of each store are made first (with map-side sums), and one row a store is joined; where those are few Spark
    broadcasts them at run time, and else it splits a store that is skewed.
    """
    bad = F.col("compliance_status") == "NON_COMPLIANT"
    per_store = inspections.groupBy(F.col("store_id").alias("of_store")).agg(F.count_if(bad).alias("n_bad"))
    return inspections.join(per_store, F.col("store_id").eqNullSafe(F.col("of_store"))).select(
        "inspection_id", (F.col("n_bad") - F.when(bad, 1).otherwise(0) > 0).alias("is_repeat"))


def liability(inspections: DataFrame, violations: DataFrame) -> DataFrame:
    per = violations.groupBy("inspection_id").agg(F.sum(compounding(F.col("amount"))).cast("decimal(28,2)").alias("liability"), F.count(F.lit(1)).alias("n"))
    return inspections.select("inspection_id").join(per, "inspection_id", "left").select(
        "inspection_id", F.coalesce("liability", F.lit(0)).cast("decimal(28,2)").alias("liability"), F.coalesce("n", F.lit(0)).alias("violations_count"))


def memo_text(inspections: DataFrame, violations: DataFrame) -> DataFrame:
    line = F.struct("rule_code", "severity", "amount")
    lines = violations.groupBy("inspection_id").agg(F.sort_array(F.collect_list(line)).alias("x"), F.sum(compounding(F.col("amount"))).alias("total"))
    text = F.array_join(F.transform("x", lambda v: F.concat_ws(" ", v["rule_code"], compounding(v["amount"]).cast("string"))), "; ")
    return repeat_offenders(inspections).join(lines, "inspection_id", "left").select("inspection_id", F.concat(
        F.lit("PENALTY MEMO | inspection "), F.col("inspection_id").cast("string"), F.lit(" | first offence: "), F.when(F.col("is_repeat"), "no").otherwise("yes"),
        F.lit(" | "), F.coalesce(text, F.lit("no violations")),
        F.lit(" | total: ₹"), F.format_number(F.coalesce("total", F.lit(0).cast("decimal(28,2)")), 2)).alias("memo"))


def penalty_memos(inspections: DataFrame, violations: DataFrame) -> DataFrame:
    """The memo of each inspection (image_id, inspection_number, store_id, compliance_status): whether it is a repeat, the penalty scale, its charges and what they come to.

    ``violations``: image_id, place (their order), rule_code, legal_reference, detected_value, issue, severity,
    compounding_amount. Charges are counted from 1; an inspection has at most one a template, so they are one row.
    """
    charge = F.struct("place", "rule_code", "legal_reference", "detected_value", "issue", "severity", compounding(F.col("compounding_amount")).alias("liability"))
    per = violations.groupBy("image_id").agg(F.sort_array(F.collect_list(charge)).alias("charges"), F.sum(compounding(F.col("compounding_amount"))).cast("decimal(28,2)").alias("total"))
    money = lambda c: F.concat(F.lit("₹"), F.format_number(c, 2))
    text = F.transform("charges", lambda v, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] Charge under "), v["legal_reference"], F.lit(":\n    - Offence: "), v["issue"], F.lit("\n    - Stamped/Detected Value: '"), v["detected_value"],
        F.lit("'\n    - Severity: "), v["severity"], F.lit("\n    - Proposed Compounding Composition: "), money(v["liability"])))
    repeats = repeat_offenders(inspections.withColumnRenamed("image_id", "inspection_id")).withColumnRenamed("inspection_id", "image_id")
    rows = inspections.select("image_id", "inspection_number").join(repeats, "image_id").join(per, "image_id", "left")
    total = F.coalesce("total", F.lit(0).cast("decimal(28,2)"))
    return rows.select(
        "inspection_number", "is_repeat", F.when(F.col("is_repeat"), REPEAT_SCALE).otherwise(FIRST_SCALE).alias("penalty_scale"), F.coalesce(F.size("charges"), F.lit(0)).cast("long").alias("n_charges"),
        F.coalesce(F.array_join(text, "\n"), F.lit("")).alias("charges"), total.alias("total_compounding_fee"), money(total).alias("total_text"))


def rule_lookup(violations: DataFrame, rules: DataFrame) -> DataFrame:
    """How often each rule was broken with each severity, beside the rule's own severity; unknown codes stay, with nulls."""
    counts = violations.groupBy("rule_code", "severity").agg(F.count(F.lit(1)).alias("n"))
    rule = rules.select("rule_code", F.col("severity").alias("rule_severity"), "legal_reference")
    return counts.join(rule, "rule_code", "left").select("rule_code", "severity", "rule_severity", "legal_reference", "n")


def severity_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("inspection_id").agg(
        F.count(F.lit(1)).alias("violations_count"), F.count_if(F.col("severity") == "CRITICAL").alias("critical_violations"),
        F.count_if(F.col("severity") == "HIGH").alias("high_violations"), F.sum("amount").cast("decimal(28,2)").alias("total_amount"))
