"""Queries over the rule engine and the field tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.operators import fields as ops
from shelfmark.operators import rules
from shelfmark.plans import statutory
from shelfmark.sources import labels
from shelfmark.sources.fields import VIEW_SQL, fields

_of = lambda f, what, raw="raw_text": f"max(CASE WHEN field_name = '{f}' THEN {what} END)"
_MISSING = "coalesce(value, '') = '' OR coalesce(status, 'MISSING') = 'MISSING'"


def _wide_sql(source: str) -> str:
    cols = []
    for f in rules.FIELDS:
        cols += [f"{_of(f, 'value')} AS {f}_value", f"coalesce({_of(f, 'raw_text')}, '') AS {f}_raw", f"bool_or(CASE WHEN field_name = '{f}' THEN {_MISSING} END) AS {f}_missing"]
    unit = "CASE " + " ".join(f"WHEN regexp_matches(lower(net_quantity_raw), '\\b{u}\\b') THEN '{u}'" for u in P.FORBIDDEN_UNITS) + " END"
    return f"""SELECT *, {unit} AS forbidden_unit, regexp_matches(lower(mrp_raw), '{P.TAX_PHRASE}') AS tax_phrase, regexp_matches(consumer_care_raw, '{P.PHONE}') AS has_phone,
        regexp_matches(consumer_care_raw, '{P.EMAIL}') AS has_email FROM (SELECT image_id, {', '.join(cols)} FROM {source} GROUP BY image_id)"""


_VIOLATIONS = " UNION ALL ".join(f"SELECT image_id, '{t.name}' AS template, '{t.rule_code}' AS rule_code, '{t.severity}' AS severity, {t.amount} AS amount, '{t.component}' AS component, {t.deduction} AS deduction FROM v_wide WHERE {rules.condition(t)}"
                                 for t in rules.TEMPLATES)
_COMPONENTS = ", ".join(f"100 - coalesce(sum(deduction) FILTER (component = '{c}'), 0) AS {c}" for c in rules.WEIGHTS)
_SCORED = f"""SELECT *, CASE WHEN critical_violations + high_violations > 0 THEN 'NON_COMPLIANT' WHEN violations_count > 0 THEN 'NEEDS_MANUAL_VERIFICATION' ELSE 'COMPLIANT' END AS compliance_status,
    critical_violations >= 2 OR score_tenths < 500 AS prosecution_recommended FROM (SELECT *, CAST(round_even(CAST(({' + '.join(f'{w} * {c}' for c, w in rules.WEIGHTS.items())}) AS DECIMAL(18,2)) / 100, 1) * 10 AS BIGINT) AS score_tenths
    FROM (SELECT w.image_id, {_COMPONENTS}, count(*) FILTER (severity = 'CRITICAL') AS critical_violations, count(*) FILTER (severity = 'HIGH') AS high_violations, count(v.template) AS violations_count,
    coalesce(sum(amount), 0) AS estimated_fee FROM v_wide w LEFT JOIN v_found v USING (image_id) GROUP BY w.image_id))"""


def scored_views(source: str) -> dict[str, str]:
    """Views that evaluate the rules over the fields of ``source``."""
    return {"v_wide": _wide_sql(source), "v_found": _VIOLATIONS, "v_scored": _SCORED}


def _sql(select: str, source: str = "v_fields", more: dict[str, str] | None = None, last: dict[str, str] | None = None) -> str:
    return labels.with_views(select, VIEW_SQL | (more or {}) | scored_views(source) | (last or {}))


_NAMES = ["mandatory", "quantity", "mrp", "care", "traceability"]
EDITED = {
    "v_edits": """SELECT *, e IS NOT NULL AND e IS DISTINCT FROM value AS changed FROM (SELECT *, CASE WHEN field_name = 'mrp' AND image_id % 4 = 0 THEN '99.00'
        WHEN field_name = 'net_quantity' AND image_id % 6 = 0 THEN '250 g' WHEN field_name = 'country_of_origin' AND image_id % 9 = 0 THEN value END AS e FROM v_fields)""",
    "v_edited": """SELECT image_id, field_name, coalesce(e, value) AS value, coalesce(e, value) AS raw_text, CASE WHEN coalesce(e, value, '') <> '' THEN 'CONFIRMED' ELSE 'MISSING' END AS status FROM v_edits"""}
CHECKED = {"v_checked": """SELECT image_id, field_name, CASE WHEN verified AND image_id % 6 = 0 THEN coalesce(upper(value), value) ELSE value END AS value,
    CASE WHEN verified AND image_id % 4 = 0 THEN coalesce('read: ' || value, raw_text) ELSE raw_text END AS raw_text, CASE WHEN verified THEN greatest(coalesce(confidence, 0), 95) ELSE confidence END AS confidence,
    CASE WHEN verified AND image_id % 5 = 0 THEN 'CONFIRMED' WHEN verified AND image_id % 5 = 1 THEN 'CONFLICTING' ELSE status END AS status, CASE WHEN verified AND image_id % 7 = 0 THEN 'blurred' END AS visual_notes,
    CASE WHEN verified THEN 'EnsembleOCR+External' ELSE 'EnsembleOCR' END AS source_model FROM (SELECT *, field_name IN ('mrp', 'net_quantity') AS verified FROM v_fields)"""}
_scores = lambda df: df.select("image_id", *_NAMES, "score_tenths")
_evaluated = lambda spark, d: rules.evaluate(rules.wide(fields(spark, d)))
_longs = lambda df: df.select(*(F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in df.dtypes))
_edits = lambda f: ops.edits(f)


def _lined(spark, d):
    """Four parts' boxes as one image's list, so that most images have more lines than a prompt takes."""
    return labels.ocr_boxes(spark, d).select(F.floor(F.col("image_id") / 4).alias("image_id"), (F.col("image_id") % 4 * 100 + F.col("idx")).alias("idx"), "text")



QUERIES = {
    "q_rule_violations": lambda spark, d: _longs(rules.violations(rules.wide(fields(spark, d)))),
    "q_violation_documents": lambda spark, d: rules.documents(rules.wide(fields(spark, d))),
    "q_rule_scores": lambda spark, d: _longs(_scores(_evaluated(spark, d))),
    "q_rule_status": lambda spark, d: _longs(_evaluated(spark, d).select("image_id", "compliance_status", "critical_violations", "high_violations", "violations_count", "estimated_fee", "prosecution_recommended")),
    "q_verify_reeval": lambda spark, d: _longs(_scores(rules.evaluate(rules.wide(ops.reevaluated(fields(spark, d), _edits(fields(spark, d))))))),
    "q_extraction_summary": lambda spark, d: ops.summary(fields(spark, d)),
    "q_declaration_rows": lambda spark, d: ops.declaration_rows(fields(spark, d)),
    "q_external_merge": lambda spark, d: ops.external_merge(fields(spark, d), ops.sample_verification(fields(spark, d))),
    "q_report_rows": lambda spark, d: ops.report_rows(ops.external_merge(fields(spark, d), ops.sample_verification(fields(spark, d))), _evaluated(spark, d)),
    "q_verified_declarations": lambda spark, d: ops.verified_declarations(fields(spark, d), _edits(fields(spark, d))),
    "q_prompt_lines": lambda spark, d: ops.prompt_lines(_lined(spark, d), 40),
    "q_result_json": lambda spark, d: ops.result_documents(fields(spark, d), _evaluated(spark, d)),
}

ORACLES = {
    "q_rule_violations": _sql("SELECT image_id, template, rule_code, severity, CAST(amount AS BIGINT) AS amount FROM v_found"),
    "q_violation_documents": _sql("SELECT * FROM v_documents", last={"v_documents": statutory.documents_sql()}),
    "q_rule_scores": _sql(f"SELECT image_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _NAMES)}, score_tenths FROM v_scored"),
    "q_rule_status": _sql("SELECT image_id, compliance_status, critical_violations, high_violations, violations_count, CAST(estimated_fee AS BIGINT) AS estimated_fee, prosecution_recommended FROM v_scored"),
    "q_verify_reeval": _sql(f"SELECT image_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _NAMES)}, score_tenths FROM v_scored", "v_edited", EDITED),
    "q_extraction_summary": _sql("""SELECT image_id, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'LOW_CONFIDENCE') AS low_confidence,
        count(*) FILTER (status = 'MISSING' OR status IS NULL) AS missing, CAST(sum(confidence) AS BIGINT) AS confidence_sum, count(confidence) AS confidence_count,
        CAST(round_even(coalesce(sum(confidence), 0) * 10.0::DOUBLE / count(*), 0) AS BIGINT) AS overall_milli FROM v_fields GROUP BY image_id"""),
    "q_declaration_rows": _sql("""SELECT image_id, field_name, value AS detected_value, coalesce(status, '') <> 'MISSING' AS is_present, CAST(coalesce(confidence, 90) AS BIGINT) AS stored_confidence,
        CASE WHEN coalesce(confidence, 0) > 60 THEN 'PASS' ELSE 'FLAGGED' END AS readability FROM v_fields"""),
    "q_external_merge": _sql("SELECT * FROM v_checked", more=CHECKED),
    "q_report_rows": _sql("""SELECT f.image_id, string_agg(field_name || '=' || substr(coalesce(value, 'NOT DETECTED'), 1, 45)
        || ' [' || CASE WHEN field_name IN ('mrp', 'net_quantity') THEN 'EnsembleOCR+External' ELSE 'EnsembleOCR' END || '] ' || CASE WHEN field_name IN ('mrp', 'net_quantity')
        THEN greatest(coalesce(confidence, 0), 95) ELSE coalesce(confidence, 0) END || '.0%', '; ' ORDER BY field_name) AS lines, any_value(score_tenths) AS score_tenths,
        format('{:,}', CAST(any_value(estimated_fee) AS BIGINT)) AS fee_text FROM (SELECT image_id, field_name, confidence,
        CASE WHEN field_name IN ('mrp', 'net_quantity') AND image_id % 6 = 0 THEN upper(value) ELSE value END AS value FROM v_fields) f JOIN v_scored s ON s.image_id = f.image_id GROUP BY f.image_id"""),
    "q_verified_declarations": _sql("""SELECT image_id, field_name, CASE WHEN changed THEN e ELSE value END AS detected_value, changed AS is_officer_edited,
        CAST(CASE WHEN changed THEN 100 ELSE confidence END AS BIGINT) AS confidence FROM v_edits""", more=EDITED),
    "q_prompt_lines": labels.with_views("SELECT image_id, string_agg(text, chr(10) ORDER BY idx) AS lines, count(*) AS n_lines FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY idx) AS rn FROM (SELECT image_id // 4 AS image_id, image_id % 4 * 100 + idx AS idx, text FROM v_boxes)) WHERE rn <= 40 GROUP BY 1"),
    "q_result_json": _sql("""SELECT f.image_id, CAST(to_json({'extracted_fields': f.x, 'audit_summary': {'total_fields': len(f.x), 'confirmed_count': f.c, 'low_confidence_count': f.l, 'missing_count': f.m},
        'score_tenths': score_tenths, 'compliance_status': compliance_status, 'estimated_fee': CAST(estimated_fee AS BIGINT)}) AS VARCHAR) AS result FROM v_scored s JOIN (SELECT image_id,
        list({'field_name': field_name, 'value': coalesce(value, ''), 'status': coalesce(status, 'MISSING'), 'confidence': CAST(coalesce(confidence, 0) AS BIGINT)} ORDER BY field_name, value) AS x,
        count(*) FILTER (status = 'CONFIRMED') AS c, count(*) FILTER (status = 'LOW_CONFIDENCE') AS l, count(*) FILTER (coalesce(status, 'MISSING') = 'MISSING') AS m FROM v_fields GROUP BY 1) f ON f.image_id = s.image_id"""),
}
