"""Dashboard aggregates over inspections and violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources import registry_views as views


def admin_summary(inspections: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: status counts, severity counts, total fee and the compliance rate in tenths of a percent.

    A registry without inspections has rate 100.0 and fee 0. Statuses outside the three known ones count in the total
    only. The rate is a decimal, so that both engines round the same exact quotient.
    """
    count_of = lambda col, value: F.count_if(F.col(col) == value)
    per_status = inspections.agg(
        F.count(F.lit(1)).alias("total_inspections"),
        count_of("compliance_status", "COMPLIANT").alias("compliant_count"),
        count_of("compliance_status", "NON_COMPLIANT").alias("non_compliant_count"),
        count_of("compliance_status", "NEEDS_MANUAL_VERIFICATION").alias("manual_count"),
        F.coalesce(F.sum("fee"), F.lit(0)).cast("decimal(28,2)").alias("total_fee"),
    )
    per_severity = violations.agg(*(count_of("severity", s).alias(f"{s.lower()}_count") for s in ("CRITICAL", "HIGH", "MEDIUM")))
    total, good = F.col("total_inspections"), F.col("compliant_count")
    rate = F.when(total == 0, F.lit(1000)).otherwise(F.floor((good * 2000 + total) / (total * 2))).cast("long")
    return per_status.join(F.broadcast(per_severity)).withColumn("compliance_rate_tenths", rate)


def top_rules(violations: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` rule codes violated most; ties go to the smaller code, the category shown is the smallest."""
    return (violations.groupBy("rule_code").agg(F.min("category").alias("category"), F.count(F.lit(1)).alias("violation_count"))
            .orderBy(F.desc("violation_count"), "rule_code").limit(n))


QUERIES = {
    "q_admin_summary": lambda spark, d: admin_summary(views.inspections(spark, d), views.violations(spark, d)),
    "q_top_rules": lambda spark, d: top_rules(views.violations(spark, d)),
}

ORACLES = {
    "q_admin_summary": views.with_views("""SELECT i.*, v.*, CAST(CASE WHEN total_inspections = 0 THEN 1000
        ELSE floor((compliant_count * 2000 + total_inspections) / (total_inspections * 2)) END AS BIGINT) AS compliance_rate_tenths
        FROM (SELECT count(*) AS total_inspections, count(*) FILTER (compliance_status = 'COMPLIANT') AS compliant_count,
        count(*) FILTER (compliance_status = 'NON_COMPLIANT') AS non_compliant_count,
        count(*) FILTER (compliance_status = 'NEEDS_MANUAL_VERIFICATION') AS manual_count,
        CAST(coalesce(sum(fee), 0) AS DECIMAL(28,2)) AS total_fee FROM v_inspections) i,
        (SELECT count(*) FILTER (severity = 'CRITICAL') AS critical_count, count(*) FILTER (severity = 'HIGH') AS high_count,
        count(*) FILTER (severity = 'MEDIUM') AS medium_count FROM v_violations) v"""),
    "q_top_rules": views.with_views("""SELECT rule_code, min(category) AS category, count(*) AS violation_count FROM v_violations
        GROUP BY rule_code ORDER BY violation_count DESC, rule_code LIMIT 5"""),
}
