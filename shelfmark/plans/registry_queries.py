"""Relational reads of the registry: listings, details, dimensions, repeat offenders and memos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import scalars as S
from shelfmark.operators import fields as field_ops
from shelfmark.operators import listings, memos
from shelfmark.sources import dimensions, labels
from shelfmark.sources import registry_views as views
from shelfmark.sources.fields import VIEW_SQL as FIELD_SQL
from shelfmark.sources.fields import fields
from shelfmark.sources.tables import table


def _listing(spark: SparkSession, d: str, **how) -> DataFrame:
    return listings.inspection_list(views.inspections(spark, d), views.stores(spark, d), views.users(spark, d), views.violations(spark, d), **how)


def _audit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("log_id"), F.upper("event_type").alias("action"), F.col("user_id").alias("officer_id"), F.col("ts").alias("logged_at"),
        F.col("props").alias("details"))


def audit_tail(logs: DataFrame, n: int = 50) -> DataFrame:
    """The newest entries; of equal times the larger id is the newer one."""
    return logs.orderBy(F.desc("logged_at"), F.desc("log_id")).limit(n).select(
        "log_id", "action", "officer_id", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("logged_text"))


def officer_resolution(users: DataFrame, codes: DataFrame) -> DataFrame:
    """Each code's user id; an unknown or null code falls back to the first inspector by id, and to 1 without inspectors."""
    first = users.where("role = 'INSPECTOR'").agg(F.min("user_id").alias("fallback_id"))
    found = codes.join(users.select("officer_code", "user_id"), "officer_code", "left")
    return found.join(F.broadcast(first)).select(
        "request_id", "officer_code", F.coalesce("user_id", "fallback_id", F.lit(1)).cast("long").alias("resolved_id"), F.col("user_id").isNotNull().alias("is_known"))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    code: Column = F.when(key % 7 == 0, F.concat(F.lit("X"), key.cast("string"))).when(key % 11 != 0, F.concat(F.lit("LMO"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")))
    return table(spark, d, "orders").select(key.alias("request_id"), code.alias("officer_code"))


def _documents(spark: SparkSession, d: str, inspection_id: int | None = None) -> DataFrame:
    """Nested rows with each struct and array as JSON, for the comparison."""
    docs = listings.inspection_documents(views.inspections(spark, d), views.stores(spark, d), views.users(spark, d), field_ops.declaration_rows(fields(spark, d)), views.violations(spark, d), inspection_id)
    said = {"declarations": F.transform("declarations", lambda x: x.withField("detected_value", F.coalesce(x["detected_value"], F.lit("")))), "violations": F.transform("violations", lambda x: x.withField("amount", x["amount"].cast("string")))}
    return docs.withColumns(said).withColumns({c: F.to_json(c) for c in ("store", "officer", "declarations", "violations")})


_DECLARED = """SELECT image_id, field_name, coalesce(value, '') AS detected_value, coalesce(status, '') <> 'MISSING' AS is_present, CAST(coalesce(confidence, 90) AS BIGINT) AS stored_confidence,
    CASE WHEN coalesce(confidence, 0) > 60 THEN 'PASS' ELSE 'FLAGGED' END AS readability FROM v_fields"""


def _documents_sql(where: str = "") -> str:
    select = f"""SELECT i.inspection_id, i.inspection_number, CASE WHEN s.store_id IS NOT NULL THEN CAST(to_json({{'store_id': s.store_id, 'store_code': s.store_code, 'store_name': s.store_name, 'fssai_license': s.fssai_license, 'city': s.city}}) AS VARCHAR) END AS store,
        CASE WHEN u.user_id IS NOT NULL THEN CAST(to_json({{'user_id': u.user_id, 'officer_code': u.officer_code, 'full_name': u.full_name}}) AS VARCHAR) END AS officer, i.category, i.compliance_status, i.score_tenths,
        strftime(i.created_at, '%Y-%m-%d %H:%M') AS created_text, i.officer_verified, i.supervisor_status, i.fee, i.image_path, i.evidence_image_path, i.sync_status,
        coalesce(CAST(to_json(f.x) AS VARCHAR), '[]') AS declarations, coalesce(CAST(to_json(v.x) AS VARCHAR), '[]') AS violations
        FROM v_inspections i LEFT JOIN v_stores s ON s.store_id = i.store_id LEFT JOIN v_users u ON u.user_id = i.officer_id
        LEFT JOIN (SELECT image_id, list({{'field_name': field_name, 'detected_value': detected_value, 'is_present': is_present, 'stored_confidence': stored_confidence, 'readability': readability}}
            ORDER BY field_name, detected_value) AS x FROM v_declared GROUP BY 1) f ON f.image_id = i.image_id
        LEFT JOIN (SELECT inspection_id, list({{'rule_code': rule_code, 'category': category, 'severity': severity, 'amount': CAST(amount AS VARCHAR)}} ORDER BY rule_code, category, severity, amount) AS x
            FROM v_violations GROUP BY 1) v ON v.inspection_id = i.inspection_id {where}"""
    return labels.with_views(select, FIELD_SQL | {"v_declared": _DECLARED} | views.VIEW_SQL)


#: The listing's SQL; {where} and {limit} are filled in.
_LIST = """SELECT i.inspection_id, i.inspection_number, i.category, i.score_tenths, i.officer_verified, coalesce(s.store_name, 'Unassigned Store') AS store_name, coalesce(u.full_name, 'Inspector') AS officer_name,
    i.compliance_status, i.supervisor_status, coalesce(v.n, 0) AS violations_count, strftime(i.created_at, '%Y-%m-%d %H:%M') AS created_text,
    coalesce(nullif(i.evidence_image_path, ''), i.image_path) AS shown_image{more} FROM v_inspections i
    LEFT JOIN v_stores s ON i.store_id = s.store_id LEFT JOIN v_users u ON i.officer_id = u.user_id LEFT JOIN v_users a ON i.assigned_to_id = a.user_id
    LEFT JOIN (SELECT inspection_id, count(*) AS n FROM v_violations GROUP BY 1) v ON v.inspection_id = i.inspection_id
    {where} ORDER BY i.created_at DESC, i.inspection_id DESC LIMIT {limit}"""
_list_sql = lambda where="", more=", i.sync_status", limit=50: views.with_views(_LIST.format(where=where, more=more, limit=limit))

QUERIES = {
    "q_inspection_list": lambda spark, d: _listing(spark, d),
    "q_inspection_list_by_status": lambda spark, d: _listing(spark, d, status="NON_COMPLIANT"),
    "q_inspection_list_by_officer": lambda spark, d: _listing(spark, d, officer_code="LMO000007"),
    "q_inspection_list_unknown_officer": lambda spark, d: _listing(spark, d, officer_code="NOBODY", status="ALL"),
    "q_supervisor_queue": lambda spark, d: _listing(spark, d, supervisor_status="ASSIGNED", with_assignee=True),
    "q_inspection_detail": lambda spark, d: listings.inspection_detail(views.inspections(spark, d), views.stores(spark, d), views.users(spark, d), views.violations(spark, d)),
    "q_inspection_documents": _documents,
    "q_inspection_by_id": lambda spark, d: _documents(spark, d, 7),
    "q_rules_catalog": lambda spark, d: listings.rules_catalog(dimensions.rules(spark), views.violations(spark, d)),
    "q_traceability": lambda spark, d: listings.traceability(dimensions.traceability(spark), field_ops.declaration_rows(fields(spark, d))),
    "q_stores": lambda spark, d: views.stores(spark, d).select("store_id", "store_code", "store_name", "city", "state", F.col("fssai_license").alias("fssai")).orderBy("store_name", "store_id"),
    "q_users_by_role": lambda spark, d: listings.users_by_role(views.users(spark, d), "SUPERVISOR"),
    "q_audit_tail": lambda spark, d: audit_tail(_audit(spark, d)),
    "q_audit_details": lambda spark, d: _audit(spark, d).select(
        "log_id", S.is_json(F.col("details")).alias("is_json"), F.length("details").cast("long").alias("details_chars")),
    "q_officer_resolution": lambda spark, d: officer_resolution(views.users(spark, d), _codes(spark, d)),
    "q_repeat_offender": lambda spark, d: memos.repeat_offenders(views.inspections(spark, d)),
    "q_penalty_memo": lambda spark, d: memos.liability(views.inspections(spark, d), views.violations(spark, d)),
    "q_memo_text": lambda spark, d: memos.memo_text(views.inspections(spark, d), views.violations(spark, d)),
    "q_violation_rule_lookup": lambda spark, d: memos.rule_lookup(views.violations(spark, d), dimensions.rules(spark)),
    "q_severity_per_inspection": lambda spark, d: memos.severity_counts(views.violations(spark, d)),
}

#: Which fields a row of the matrix is about, by words of its name.
_ABOUT = """CASE WHEN t.declaration LIKE 'Generic%' THEN f.field_name = 'product_name' WHEN t.declaration LIKE 'Manufacturer%' THEN f.field_name IN ('manufacturer_name', 'manufacturer_address')
    WHEN t.declaration LIKE 'Net Quantity%' THEN f.field_name = 'net_quantity' WHEN t.declaration LIKE 'Month%' THEN f.field_name = 'manufacturing_date' WHEN t.declaration LIKE 'Maximum%' THEN f.field_name = 'mrp'
    WHEN t.declaration LIKE 'Consumer%' THEN f.field_name = 'consumer_care' WHEN t.declaration LIKE 'Country%' THEN f.field_name = 'country_of_origin' WHEN t.declaration LIKE 'Batch%' THEN f.field_name = 'batch_number'
    WHEN t.declaration LIKE 'Best Before%' THEN f.field_name = 'expiry_date' ELSE FALSE END"""

ORACLES = {
    "q_inspection_list": _list_sql(),
    "q_inspection_list_by_status": _list_sql("WHERE i.compliance_status = 'NON_COMPLIANT'"),
    "q_inspection_list_by_officer": _list_sql("WHERE u.officer_code = 'LMO000007'"),
    "q_inspection_list_unknown_officer": _list_sql(),
    "q_supervisor_queue": _list_sql("WHERE i.supervisor_status = 'ASSIGNED'", ", a.full_name AS assigned_name, i.fee"),
    "q_inspection_detail": views.with_views("""SELECT i.inspection_id, s.store_code, s.store_name, u.officer_code, v.codes, coalesce(v.n, 0) AS violations_count
        FROM v_inspections i LEFT JOIN v_stores s ON i.store_id = s.store_id LEFT JOIN v_users u ON i.officer_id = u.user_id LEFT JOIN (SELECT inspection_id, count(*) AS n,
        string_agg(rule_code || ':' || severity || ':' || CAST(amount AS VARCHAR), ',' ORDER BY rule_code, severity, amount) AS codes FROM v_violations GROUP BY 1) v ON v.inspection_id = i.inspection_id"""),
    "q_inspection_documents": _documents_sql(),
    "q_inspection_by_id": _documents_sql("WHERE i.inspection_id = 7"),
    "q_rules_catalog": views.with_views("""SELECT r.rule_code, r.category, r.severity, CASE WHEN r.severity = 'CRITICAL' THEN 10000 ELSE 5000 END AS fee, r.legal_reference, r.legal_reference AS rule_clause,
        (SELECT count(*) FROM v_violations v WHERE v.rule_code = r.rule_code) AS violations_count FROM (""" + dimensions.RULES_SQL + ") r ORDER BY r.rule_code"),
    "q_traceability": labels.with_views(f"""SELECT t.*, (SELECT count(*) FROM v_fields f WHERE {_ABOUT}) AS declared, (SELECT count(*) FROM v_fields f WHERE {_ABOUT} AND coalesce(f.status, '') <> 'MISSING') AS present
        FROM ({dimensions.TRACEABILITY_SQL}) t""", FIELD_SQL),
    "q_stores": views.with_views("SELECT store_id, store_code, store_name, city, state, fssai_license AS fssai FROM v_stores"),
    "q_users_by_role": views.with_views("SELECT user_id, officer_code, full_name, role, is_active FROM v_users WHERE role = 'SUPERVISOR'"),
    "q_audit_tail": """SELECT event_id AS log_id, upper(event_type) AS action, user_id AS officer_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged_text
        FROM events ORDER BY ts DESC, event_id DESC LIMIT 50""",
    "q_audit_details": "SELECT event_id AS log_id, json_valid(props) AS is_json, CAST(length(props) AS BIGINT) AS details_chars FROM events",
    "q_officer_resolution": views.with_views("""SELECT c.request_id, c.officer_code, coalesce(u.user_id, (SELECT min(user_id) FROM v_users WHERE role = 'INSPECTOR'), 1) AS resolved_id,
        u.user_id IS NOT NULL AS is_known FROM (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' || o_orderkey WHEN o_orderkey % 11 <> 0 THEN
        'LMO' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS officer_code FROM orders) c LEFT JOIN v_users u ON u.officer_code = c.officer_code"""),
    "q_repeat_offender": views.with_views("""SELECT i.inspection_id, EXISTS (SELECT 1 FROM v_inspections o WHERE o.compliance_status = 'NON_COMPLIANT'
        AND o.store_id IS NOT DISTINCT FROM i.store_id AND o.inspection_id <> i.inspection_id) AS is_repeat FROM v_inspections i"""),
    "q_penalty_memo": views.with_views("""SELECT i.inspection_id, coalesce(v.liability, 0) AS liability, coalesce(v.n, 0) AS violations_count FROM v_inspections i LEFT JOIN (SELECT inspection_id,
        CAST(sum(coalesce(nullif(amount, 0), 5000)) AS DECIMAL(28,2)) AS liability, count(*) AS n FROM v_violations GROUP BY 1) v ON v.inspection_id = i.inspection_id"""),
    "q_memo_text": views.with_views("""SELECT i.inspection_id, 'PENALTY MEMO | inspection ' || i.inspection_id || ' | first offence: ' || CASE WHEN (SELECT count(*) FROM v_inspections o WHERE
        o.compliance_status = 'NON_COMPLIANT' AND o.store_id IS NOT DISTINCT FROM i.store_id AND o.inspection_id <> i.inspection_id) > 0 THEN 'no' ELSE 'yes' END || ' | ' || coalesce(v.lines, 'no violations')
        || ' | total: ₹' || format('{:,.2f}', CAST(coalesce(v.total, 0) AS DOUBLE)) AS memo
        FROM v_inspections i LEFT JOIN (SELECT inspection_id, string_agg(rule_code || ' ' || CAST(CAST(coalesce(nullif(amount, 0), 5000) AS DECIMAL(18,2)) AS VARCHAR), '; ' ORDER BY rule_code, severity, amount) AS lines,
        sum(coalesce(nullif(amount, 0), 5000)) AS total FROM v_violations GROUP BY 1) v ON v.inspection_id = i.inspection_id"""),
    "q_violation_rule_lookup": views.with_views("SELECT v.rule_code, v.severity, r.severity AS rule_severity, r.legal_reference, count(*) AS n FROM v_violations v LEFT JOIN ("
        + dimensions.RULES_SQL + ") r ON r.rule_code = v.rule_code GROUP BY ALL"),
    "q_severity_per_inspection": views.with_views("""SELECT inspection_id, count(*) AS violations_count, count(*) FILTER (severity = 'CRITICAL') AS critical_violations,
        count(*) FILTER (severity = 'HIGH') AS high_violations, CAST(sum(amount) AS DECIMAL(28,2)) AS total_amount FROM v_violations GROUP BY 1"""),
}
