"""Adapter views: the driver's star schema seen as an inspection registry.

Every view is a deterministic projection, so DuckDB can state the same view in SQL (``VIEW_SQL``). NULLs that the
driver's tables lack are made here (stores, assignees), so that the NULL paths of the queries are run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.tables import table


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("store_id"),
        F.concat(F.lit("STR-"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("store_code"),
        F.col("s_name").alias("store_name"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        F.concat(F.lit("FL"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("fssai_license"),
    ).hint("merge")  # grows with the registry, and is several times its file's size once it is on the driver


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    role = (F.when(segment.isin("BUILDING", "FURNITURE"), "INSPECTOR").when(segment == "AUTOMOBILE", "SUPERVISOR")
            .when(segment == "MACHINERY", "ADMIN").otherwise("LEGAL_REVIEWER"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("LMO"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("officer_code"),
        F.col("c_name").alias("full_name"),
        role.alias("role"),
        (F.col("c_custkey") % 13 != 0).alias("is_active"),
    ).hint("merge")


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One inspection per order. ``store_id`` falls on 1..n_stores, so the last store id wraps to store 0 (no such
    store): the left join's unmatched path is run as well as the NULL path."""
    n_stores = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n_stores")).join(F.broadcast(table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n_images"))))
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    priority = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").join(F.broadcast(n_stores)).select(
        key.alias("inspection_id"),
        F.when(key % 17 != 0, key % F.col("n_stores")).alias("store_id"),
        F.col("o_custkey").alias("officer_id"),
        F.when(key % 3 == 0, key % 100 + 1).alias("assigned_to_id"),
        F.when(key % 50 == 0, "PENDING_AUDIT").when(status == "F", "NON_COMPLIANT").when(status == "O", "COMPLIANT")
        .otherwise("NEEDS_MANUAL_VERIFICATION").alias("compliance_status"),
        F.when(priority == "1", "PENDING").when(priority == "2", "ASSIGNED").when(priority == "3", "COMPOUNDED")
        .when(priority == "4", "REFERRED_FOR_PROSECUTION").otherwise("APPROVED").alias("supervisor_status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("fee"),
        F.when(key % 5 == 0, "").when(key % 5 == 1, F.concat(F.lit("ev/"), key.cast("string"), F.lit(".jpg"))).alias("evidence_image_path"),
        F.concat(F.lit("img/"), key.cast("string"), F.lit(".jpg")).alias("image_path"),
        F.concat(F.lit("INSP-2026-"), F.lpad(key.cast("string"), 8, "0")).alias("inspection_number"),
        F.when(key % 4 == 0, "Food").when(key % 4 == 1, "Cosmetics").otherwise("Packaged Commodity").alias("category"),
        (key % 1001).alias("score_tenths"),
        (key % 3 == 1).alias("officer_verified"),
        F.when(key % 10 == 0, "PENDING").otherwise("SYNCED").alias("sync_status"),
        (key % F.col("n_images") + 1).alias("image_id"),
    )


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("inspection_id"),
        F.concat(F.lit("LM-PC-00"), F.col("l_linenumber").cast("string")).alias("rule_code"),
        F.concat(F.lit("CAT-"), F.col("l_linestatus")).alias("category"),
        F.when(flag == "R", "CRITICAL").when(flag == "A", "HIGH").otherwise("MEDIUM").alias("severity"),
        F.when(F.col("l_discount") == 0, 0).otherwise(F.col("l_extendedprice")).cast("decimal(18,2)").alias("amount"),
    )


#: The same views for DuckDB, to be put before an oracle with ``with_views``.
VIEW_SQL = {
    "v_stores": """SELECT s_suppkey AS store_id, 'STR-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS store_code, s_name AS store_name,
        n_name AS city, r_name AS state, 'FL' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS fssai_license
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_users": """SELECT c_custkey AS user_id, 'LMO' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS officer_code, c_name AS full_name,
        CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'INSPECTOR' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'SUPERVISOR'
        WHEN c_mktsegment = 'MACHINERY' THEN 'ADMIN' ELSE 'LEGAL_REVIEWER' END AS role, c_custkey % 13 <> 0 AS is_active FROM customer""",
    "v_inspections": """SELECT o_orderkey AS inspection_id,
        CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % (SELECT count(*) FROM supplier) END AS store_id, o_custkey AS officer_id,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 + 1 END AS assigned_to_id,
        CASE WHEN o_orderkey % 50 = 0 THEN 'PENDING_AUDIT' WHEN o_orderstatus = 'F' THEN 'NON_COMPLIANT'
        WHEN o_orderstatus = 'O' THEN 'COMPLIANT' ELSE 'NEEDS_MANUAL_VERIFICATION' END AS compliance_status,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'PENDING' WHEN '2' THEN 'ASSIGNED' WHEN '3' THEN 'COMPOUNDED'
        WHEN '4' THEN 'REFERRED_FOR_PROSECUTION' ELSE 'APPROVED' END AS supervisor_status,
        o_orderdate AS created_at, CAST(o_totalprice AS DECIMAL(18,2)) AS fee,
        CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN 'ev/' || o_orderkey || '.jpg' END AS evidence_image_path,
        'img/' || o_orderkey || '.jpg' AS image_path, 'INSP-2026-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS inspection_number,
        CASE o_orderkey % 4 WHEN 0 THEN 'Food' WHEN 1 THEN 'Cosmetics' ELSE 'Packaged Commodity' END AS category, o_orderkey % 1001 AS score_tenths,
        o_orderkey % 3 = 1 AS officer_verified, CASE WHEN o_orderkey % 10 = 0 THEN 'PENDING' ELSE 'SYNCED' END AS sync_status,
        o_orderkey % (SELECT count(*) FROM part) + 1 AS image_id FROM orders""",
    "v_violations": """SELECT l_orderkey AS inspection_id, 'LM-PC-00' || l_linenumber AS rule_code, 'CAT-' || l_linestatus AS category,
        CASE l_returnflag WHEN 'R' THEN 'CRITICAL' WHEN 'A' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
        CAST(CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount FROM lineitem""",
}


def with_views(sql: str, views: dict[str, str] | None = None) -> str:
    """``sql`` with the views that it names in front."""
    named = {k: v for k, v in (VIEW_SQL | (views or {})).items() if k in sql}
    return ("WITH " + ", ".join(f"{k} AS ({v})" for k, v in named.items()) + " " if named else "") + sql
