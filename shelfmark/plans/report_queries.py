"""Queries over reports and their sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import creation, reports
from shelfmark.operators import fields as field_ops
from shelfmark.plans import rule_queries, statutory
from shelfmark.plans.creation_queries import created_sql
from shelfmark.sources import registry_views as views
from shelfmark.sources.shared import shared_path
from shelfmark.sources.submissions import requested_fields, requests


def documents(spark: SparkSession, d: str) -> DataFrame:
    fields = requested_fields(spark, d)
    return reports.documents(creation.heads(requests(spark, d), views.stores(spark, d)), field_ops.external_merge(fields, field_ops.sample_verification(fields)))


def _flat(docs: DataFrame) -> DataFrame:
    return docs.withColumns({c: F.to_json(c) for c in ("declarations", "violations")})


def _regenerated(spark: SparkSession, d: str) -> DataFrame:
    """The sink after two runs, of which the first had every third report alone."""
    path, docs = shared_path(spark, "reports"), documents(spark, d)
    reports.written(docs.where(F.crc32("inspection_number") % 3 == 0), path)
    return _flat(reports.written(docs, path))


QUERIES = {"q_report_documents": lambda spark, d: _flat(documents(spark, d)), "q_reports_regenerated": _regenerated}

#: The declarations that a report shows, written out once more for the oracle.
_SHOWN = """(VALUES (0, 'product_name', 'Product Common Name (6(1)(a))'), (1, 'manufacturer_name', 'Manufacturer / Packer (6(1)(b))'), (2, 'manufacturer_address', 'Complete Address (6(1)(b))'),
    (3, 'net_quantity', 'Net Quantity (6(1)(c) & R12)'), (4, 'mrp', 'MRP (Incl. of all taxes) (6(1)(e))'), (5, 'manufacturing_date', 'Mfg / Pkg Date (6(1)(d))'),
    (6, 'consumer_care', 'Consumer Care Details (6(1)(n))'), (7, 'country_of_origin', 'Country of Origin (6(1)(f))'), (8, 'batch_number', 'Batch / Lot No.')) s(n, field_name, label)"""


def _documents_sql() -> str:
    checked = rule_queries.CHECKED["v_checked"].replace("FROM v_fields)", "FROM v_fields WHERE image_id % 11 <> 0)")
    every = "SELECT p.p_partkey AS image_id, f.field_name, f.value, f.raw_text, f.status FROM part p LEFT JOIN x_checked f ON f.image_id = p.p_partkey"
    again = {k.replace("v_", "x_"): v.replace("v_wide", "x_wide").replace("v_found", "x_found") for k, v in rule_queries.scored_views("x_every").items()}
    views = {"x_checked": checked, "x_every": every} | again | {"x_documents": statutory.documents_sql("x_found", "x_wide")}
    named = ", ".join(f"{k} AS ({v})" for k, v in views.items())
    score = "(x.score_tenths // 10) || '.' || (x.score_tenths % 10)"
    return created_sql(f"""SELECT * FROM (WITH {named},
        d AS (SELECT p.p_partkey AS image_id, list({{'declaration': s.label, 'value': substr(coalesce(nullif(f.value, ''), 'NOT DETECTED'), 1, 45), 'source': substr(coalesce(f.source_model, 'Ensemble'), 1, 20),
            'confidence': coalesce(f.confidence, 0) || '.0%', 'compliance': CASE WHEN f.status = 'CONFIRMED' THEN 'PASS' ELSE 'FLAGGED / MISSING' END}} ORDER BY s.n) AS rows,
            max(CASE WHEN s.n = 0 THEN f.value END) AS product FROM part p, {_SHOWN} LEFT JOIN x_checked f ON f.image_id = p.p_partkey AND f.field_name = s.field_name GROUP BY 1),
        v AS (SELECT image_id, list({{'place': place, 'rule_code': rule_code, 'legal_reference': legal_reference, 'issue': issue, 'severity': severity, 'fee': '₹' || format('{{:,}}', amount)}} ORDER BY place) AS rows FROM x_documents GROUP BY 1)
        SELECT c.inspection_number, coalesce(nullif(d.product, ''), 'Packaged Commodity') AS product_name, c.category, {score} AS compliance_score, x.compliance_status, CAST(to_json(d.rows) AS VARCHAR) AS declarations,
        coalesce(CAST(to_json(v.rows) AS VARCHAR), '[]') AS violations, '₹' || format('{{:,}}', CAST(x.estimated_fee AS BIGINT)) AS compounding_fee,
        CASE WHEN x.prosecution_recommended THEN 'YES — Refer to Judicial Magistrate First Class' ELSE 'Eligible for Compounding under Section 48' END AS prosecution,
        sha256(c.inspection_number || '|' || c.store_code || '|' || {score} || '|' || x.violations_count || '|' || CAST(x.estimated_fee AS BIGINT) || '.0') AS digest
        FROM v_created c JOIN x_scored x ON x.image_id = c.image_id JOIN d ON d.image_id = c.image_id LEFT JOIN v ON v.image_id = c.image_id)""")


ORACLES = {"q_report_documents": _documents_sql(), "q_reports_regenerated": _documents_sql()}
