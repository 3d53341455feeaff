"""Queries over the tables that new inspections and stores add rows to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import creation, payloads
from shelfmark.operators import fields as field_ops
from shelfmark.operators import memos, workflow
from shelfmark.plans import rule_queries, statutory
from shelfmark.sources import dimensions, labels
from shelfmark.sources import registry_views as views
from shelfmark.sources import submissions as sent
from shelfmark.sources.fields import VIEW_SQL as FIELD_SQL
from shelfmark.sources.submissions import requested_fields, requests
from shelfmark.sources.tables import table


def created(spark: SparkSession, d: str) -> DataFrame:
    return creation.inspections(requests(spark, d), requested_fields(spark, d), views.stores(spark, d), views.users(spark, d))


def _store_requests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    given = lambda n, c: F.when(k % n == 0, c)
    return table(spark, d, "customer").select(
        k.alias("request_id"), F.when(k % 4 != 0, F.col("c_name")).alias("store_name"), given(5, F.concat(F.lit("Owner "), k.cast("string"))).alias("owner_name"),
        given(7, F.concat(F.lit("29GST"), k.cast("string"))).alias("gstin"), given(2, k.cast("string")).alias("fssai"), given(3, F.lit("Station Road")).alias("address"),
        given(3, F.lit("Pune")).alias("city"), given(6, F.lit("Maharashtra")).alias("state"), given(6, F.lit("411001")).alias("pincode"),
        given(6, F.lit("18.5204")).cast("decimal(9,4)").alias("gps_lat"), given(6, F.lit("73.8567")).cast("decimal(9,4)").alias("gps_lng"))


def _verified(spark: SparkSession, d: str) -> DataFrame:
    f = requested_fields(spark, d)
    return creation.verified(created(spark, d), f, field_ops.edits(f))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Submissions read from JSON, checked and created."""
    checked = payloads.checked(sent.submissions(spark, d))
    entries = payloads.declared(payloads.entries(checked.where("error IS NULL")))
    asked = checked.where("error IS NULL").withColumnRenamed("offline_id", "image_id")
    fields = entries.select(F.col("offline_id").alias("image_id"), "field_name", F.col("detected_value").alias("value"), "raw_text", "status", "confidence")
    made = creation.inspections(asked, fields, views.stores(spark, d), views.users(spark, d))
    return payloads.results(checked, made)


def _notices(spark: SparkSession, d: str) -> DataFrame:
    """Memos of the created inspections; stores by their code, so that each new store is one of its own."""
    made = created(spark, d).select("image_id", "inspection_number", F.col("store_code").alias("store_id"), "compliance_status")
    return memos.penalty_memos(made, creation.violations(requests(spark, d), requested_fields(spark, d), dimensions.rules(spark)))


QUERIES = {
    "q_create_store": lambda spark, d: creation.stores(_store_requests(spark, d)),
    "q_new_stores": lambda spark, d: creation.new_stores(requests(spark, d), views.stores(spark, d)),
    "q_create_inspection": created,
    "q_created_declarations": lambda spark, d: creation.declarations(requests(spark, d), requested_fields(spark, d)),
    "q_created_violations": lambda spark, d: creation.violations(requests(spark, d), requested_fields(spark, d), dimensions.rules(spark)).drop("image_id"),
    "q_created_audits": lambda spark, d: creation.audits(created(spark, d)),
    "q_verify_inspection": _verified,
    "q_penalty_notices": _notices,
    "q_payload_entries": lambda spark, d: payloads.entries(sent.submissions(spark, d)).select("offline_id", "field_name", "kind"),
    "q_payload_declarations": lambda spark, d: payloads.declared(payloads.entries(sent.submissions(spark, d))).drop("raw_text", "status"),
    "q_sync_results": _results,
    "q_sync_summary": lambda spark, d: workflow.sync_summary(payloads.results(payloads.checked(sent.submissions(spark, d)), requests(spark, d).withColumn("inspection_number", creation.inspection_number(F.col("image_id"))))),
}

_digest = lambda prefix, of: f"'{prefix}' || upper(substr(sha256(CAST({of} AS VARCHAR)), 1, 6))"
_ALL = "SELECT p.p_partkey AS image_id, f.field_name, f.value, f.raw_text, f.status, f.confidence FROM part p LEFT JOIN v_fields f ON f.image_id = p.p_partkey AND f.image_id % 11 <> 0"
CREATED_SQL = f"""SELECT image_id, inspection_number, store_code, officer_id, category, compliance_status, score_tenths, breakdown, violations_count, fee, 'PENDING' AS supervisor_status, 'SYNCED' AS sync_status,
    sha256(inspection_number || '|' || store_code || '|' || (score_tenths // 10) || '.' || (score_tenths % 10) || '|' || violations_count) AS sha256_hash FROM (SELECT r.image_id, {_digest('INSP-2026-', 'r.image_id')} AS inspection_number,
    coalesce(s.store_code, {_digest('STR-', 'r.image_id')}) AS store_code, coalesce(u.user_id, (SELECT min(user_id) FROM v_users WHERE role = 'INSPECTOR'), 1) AS officer_id, coalesce(r.category, 'Packaged Commodity') AS category,
    e.compliance_status, e.score_tenths, e.mandatory || '/' || e.quantity || '/' || e.mrp || '/' || e.care || '/' || e.traceability AS breakdown, e.violations_count, CAST(e.estimated_fee AS BIGINT) AS fee
    FROM v_requests r JOIN v_scored e ON e.image_id = r.image_id LEFT JOIN v_users u ON u.officer_code = r.officer_code LEFT JOIN v_stores s ON s.store_id = r.store_id)"""


def created_sql(select: str) -> str:
    """``select`` over v_created, the inspections of the requests, and all views that those are made of."""
    parts = FIELD_SQL | {"v_all": _ALL} | rule_queries.scored_views("v_all") | views.VIEW_SQL | sent.VIEW_SQL | {"v_documents": statutory.documents_sql(), "v_created": CREATED_SQL}
    return labels.with_views(select, parts)


def _verified_sql() -> str:
    """Every request is verified, those without a field as well."""
    edited = {k: v.replace("v_fields", "v_some") for k, v in rule_queries.EDITED.items()}
    every = {"v_again": "SELECT p.p_partkey AS image_id, f.field_name, f.value, f.raw_text, f.status FROM part p LEFT JOIN v_edited f ON f.image_id = p.p_partkey"}
    again = {k.replace("v_", "w_"): v.replace("v_wide", "w_wide").replace("v_found", "w_found") for k, v in rule_queries.scored_views("v_again").items()}
    parts = FIELD_SQL | {"v_some": "SELECT * FROM v_fields WHERE image_id % 11 <> 0"} | edited | every | again
    return labels.with_views(f"""SELECT w.image_id, {_digest('INSP-2026-', 'w.image_id')} AS inspection_number, coalesce(u.user_id, (SELECT min(user_id) FROM v_users WHERE role = 'INSPECTOR'), 1) AS officer_id, TRUE AS officer_verified,
        w.compliance_status, w.score_tenths, CAST(w.estimated_fee AS BIGINT) AS fee, 'INSPECTION_OFFICER_VERIFIED' AS audit_action,
        '{{"edited_fields":[' || coalesce(x.names, '') || '],"new_score_tenths":' || w.score_tenths || '}}' AS audit_details FROM w_scored w
        LEFT JOIN v_users u ON w.image_id % 6 <> 0 AND u.officer_code = 'LMO' || lpad(CAST(w.image_id % 20 + 1 AS VARCHAR), 6, '0')
        LEFT JOIN (SELECT image_id, string_agg('"' || field_name || '"', ',' ORDER BY field_name) AS names FROM v_edits WHERE e IS NOT NULL GROUP BY 1) x ON x.image_id = w.image_id""", parts | {"v_users": views.VIEW_SQL["v_users"]})


_CREATABLE = "v_fields f JOIN v_sent s ON s.offline_id = f.image_id AND s.error IS NULL WHERE f.image_id % 11 <> 0"
ORACLES = {
    "q_create_store": f"""SELECT c_custkey AS request_id, {_digest('STR-', 'c_custkey')} AS store_code, CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE 'Retail Store' END AS store_name,
        CASE WHEN c_custkey % 5 = 0 THEN 'Owner ' || c_custkey END AS owner_name, CASE WHEN c_custkey % 7 = 0 THEN '29GST' || c_custkey END AS gstin,
        CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END AS fssai_license, CASE WHEN c_custkey % 3 = 0 THEN 'Station Road' ELSE 'Market Area' END AS address,
        CASE WHEN c_custkey % 3 = 0 THEN 'Pune' ELSE 'Bengaluru' END AS city, CASE WHEN c_custkey % 6 = 0 THEN 'Maharashtra' ELSE 'Karnataka' END AS state, CASE WHEN c_custkey % 6 = 0 THEN '411001' ELSE '560001' END AS pincode,
        CAST(CASE WHEN c_custkey % 6 = 0 THEN 18.5204 ELSE 12.9716 END AS DECIMAL(9,4)) AS gps_lat, CAST(CASE WHEN c_custkey % 6 = 0 THEN 73.8567 ELSE 77.5946 END AS DECIMAL(9,4)) AS gps_lng FROM customer""",
    "q_new_stores": created_sql(f"""SELECT image_id, {_digest('STR-', 'image_id')} AS store_code, coalesce(store_name, 'General Retail Store') AS store_name, CAST(NULL AS VARCHAR) AS owner_name, CAST(NULL AS VARCHAR) AS gstin,
        CAST(NULL AS VARCHAR) AS fssai_license, coalesce(store_address, 'Market Area, Bengaluru') AS address, 'Bengaluru' AS city, 'Karnataka' AS state, '560001' AS pincode, CAST(12.9716 AS DECIMAL(9,4)) AS gps_lat,
        CAST(77.5946 AS DECIMAL(9,4)) AS gps_lng FROM v_requests WHERE store_id IS NULL OR store_id NOT IN (SELECT store_id FROM v_stores)"""),
    "q_create_inspection": created_sql("SELECT * FROM v_created"),
    "q_created_declarations": created_sql("""SELECT c.inspection_number, f.field_name, f.value AS detected_value, coalesce(f.status, '') <> 'MISSING' AS is_present, CAST(coalesce(f.confidence, 90) AS BIGINT) AS stored_confidence,
        CASE WHEN coalesce(f.confidence, 0) > 60 THEN 'PASS' ELSE 'FLAGGED' END AS readability FROM v_created c JOIN v_fields f ON f.image_id = c.image_id AND f.image_id % 11 <> 0"""),
    "q_created_violations": created_sql(f"""SELECT {_digest('INSP-2026-', 'v.image_id')} AS inspection_number, v.place, v.template, CAST(substr(v.rule_code, 8) AS BIGINT) AS rule_id, v.rule_code, v.category, v.issue, v.detected_value,
        v.expected_requirement, v.severity, v.confidence, v.legal_reference, v.evidence_zone, v.amount AS compounding_amount, 'OPEN' AS status FROM v_documents v"""),
    "q_created_audits": created_sql("""SELECT officer_id, 'INSPECTION_CREATED' AS action, 'INSPECTION' AS target_type, inspection_number AS target_id,
        '{"score_tenths":' || score_tenths || ',"status":"' || compliance_status || '","violations_count":' || violations_count || '}' AS details FROM v_created"""),
    "q_verify_inspection": _verified_sql(),
    "q_penalty_notices": created_sql("""SELECT inspection_number, is_repeat, CASE WHEN is_repeat THEN 'SECOND / SUBSEQUENT OFFENCE — Penalty up to ₹50,000 / ₹1,00,000 or imprisonment under Section 36(1)'
        ELSE 'FIRST OFFENCE — Penalty up to ₹25,000 per violation under Section 36(1)' END AS penalty_scale, coalesce(n, 0) AS n_charges, coalesce(charges, '') AS charges, CAST(coalesce(total, 0) AS DECIMAL(28,2)) AS total_compounding_fee,
        '₹' || format('{:,.2f}', CAST(coalesce(total, 0) AS DOUBLE)) AS total_text FROM (SELECT c.inspection_number, (SELECT count(*) FROM v_created o WHERE o.store_code = c.store_code AND o.compliance_status = 'NON_COMPLIANT'
        AND o.image_id <> c.image_id) > 0 AS is_repeat, v.* FROM v_created c LEFT JOIN (SELECT image_id AS i, count(*) AS n, sum(amount) AS total, string_agg('[' || (place + 1) || '] Charge under ' || legal_reference || ':' || chr(10)
        || '    - Offence: ' || issue || chr(10) || '    - Stamped/Detected Value: ' || chr(39) || detected_value || chr(39) || chr(10) || '    - Severity: ' || severity || chr(10) || '    - Proposed Compounding Composition: ₹'
        || format('{:,.2f}', CAST(amount AS DOUBLE)), chr(10) ORDER BY place) AS charges FROM v_documents GROUP BY 1) v ON v.i = c.image_id)"""),
    "q_payload_entries": created_sql(f"""SELECT f.image_id AS offline_id, field_name, 'OBJECT' AS kind FROM {_CREATABLE} UNION ALL SELECT offline_id, n, k FROM v_sent,
        (VALUES ('note', 'STRING'), ('count', 'BIGINT'), ('gone', 'VOID'), ('list', 'ARRAY')) x(n, k) WHERE error IS NULL UNION ALL SELECT offline_id, 'mrp', 'STRING' FROM v_sent WHERE error = 'FIELD_NOT_AN_OBJECT'"""),
    "q_payload_declarations": created_sql(f"""SELECT f.image_id AS offline_id, field_name, value AS detected_value, value AS normalized_value, CASE WHEN field_name = 'net_quantity' THEN 'g' END AS unit,
        coalesce(status, '') <> 'MISSING' AS is_present, CAST(coalesce(confidence, 90) AS BIGINT) AS confidence, CASE WHEN coalesce(confidence, 0) > 60 THEN 'PASS' ELSE 'FLAGGED' END AS readability_status,
        CASE WHEN image_id % 2 = 0 THEN '[0,0,' || image_id % 100 || ',20]' END AS raw_bounding_box, field_name = 'mrp' AND image_id % 9 = 0 AS is_officer_edited,
        CASE WHEN field_name = 'mrp' AND image_id % 9 = 0 THEN 'seen again' END AS officer_notes FROM {_CREATABLE}"""),
    "q_sync_results": created_sql(f"""SELECT offline_id, CASE WHEN error IS NULL THEN {_digest('INSP-2026-', 'offline_id')} END AS server_inspection_number, error, CASE WHEN error IS NULL THEN 'SYNCED' ELSE 'FAILED' END AS status FROM v_sent"""),
    "q_sync_summary": created_sql("SELECT count(*) AS attempted, count(*) FILTER (error IS NULL) AS synced FROM v_sent"),
}
