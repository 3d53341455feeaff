"""The rule engine as expressions: one wide row an inspection, deductions by component, violations as an array."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import scalars as S

FIELDS = ["product_name", "manufacturer_name", "manufacturer_address", "net_quantity", "mrp", "manufacturing_date", "consumer_care", "country_of_origin"]
#: component: weight in hundredths of the score
WEIGHTS = {"mandatory": 25, "quantity": 25, "mrp": 25, "care": 15, "traceability": 10}


@dataclass
class Template:
    """A violation: its rule, the component it takes points from, when it holds (of the wide row's columns), and what it says.

    ``detected`` is an SQL expression over the wide row; in ``issue``, {} stands for the value of ``names``, another one.
    ``confidence`` is in hundredths.
    """

    name: str
    rule_code: str
    severity: str
    amount: int
    component: str
    deduction: int
    holds: str
    category: str
    issue: str
    detected: str
    expected: str
    confidence: int
    legal_reference: str
    zone: str
    names: str | None = None

    def when(self) -> Column:
        return F.expr(self.holds)


# Severity, amount, component and deduction of each template, and its words. missing(x) and present(x) are filled in below.
_NONE = "'Not Detected'"
TEMPLATES = [
    Template("R1", "LM-PC-001", "CRITICAL", 10000, "mandatory", 30, "missing(product_name)", "Product Identity",
             "Generic or common name of commodity is missing on the Principal Display Panel.", _NONE,
             "Generic or common name must be prominently displayed (Rule 6(1)(a)).", 96, "Rule 6(1)(a), Legal Metrology (PC) Rules, 2011", "Header / Display Panel"),
    Template("R2", "LM-PC-002", "HIGH", 5000, "mandatory", 25, "missing(manufacturer_name)", "Manufacturer Traceability",
             "Name of manufacturer, packer, or importer missing from package.", _NONE,
             "Name and identity of manufacturer or packer must be stated (Rule 6(1)(b)).", 95, "Rule 6(1)(b), Legal Metrology (PC) Rules, 2011", "Manufacturer Zone"),
    Template("R3a", "LM-PC-003", "HIGH", 5000, "traceability", 30, "missing(manufacturer_address)", "Manufacturer Address",
             "Complete address of manufacturer or packer missing from package.", _NONE,
             "Complete address with street, city, state and PIN code required (Rule 6(1)(b)).", 92, "Rule 6(1)(b), Legal Metrology (PC) Rules, 2011", "Address Zone"),
    Template("R3b", "LM-PC-003", "MEDIUM", 3000, "traceability", 15, "present(manufacturer_address) AND length(manufacturer_address_value) < 15", "Manufacturer Address",
             "Incomplete manufacturer address; lacking full postal traceability.", "manufacturer_address_value",
             "Full address enabling postal and regulatory contact must be stated (Rule 6(1)(b)).", 88, "Rule 6(1)(b), Legal Metrology (PC) Rules, 2011", "Address Zone"),
    Template("R4a", "LM-PC-004", "CRITICAL", 15000, "quantity", 50, "missing(net_quantity)", "Net Quantity Standard",
             "Net quantity declaration missing from package.", _NONE,
             "Net weight or measure must be clearly stated in standard SI units (Rule 6(1)(c)).", 98, "Rule 6(1)(c) & Rule 12, Legal Metrology (PC) Rules, 2011", "Net Quantity Zone"),
    Template("R4b", "LM-PC-004", "HIGH", 5000, "quantity", 30, "present(net_quantity) AND forbidden_unit IS NOT NULL", "Net Quantity Standard",
             "Forbidden non-standard unit abbreviation '{}' detected in net quantity.", "trim(net_quantity_raw)",
             "Only legal standard symbols permitted: g, kg, ml, l. Forbidden: gm, gms, ltrs (Rule 12).", 94, "Rule 12 & Schedule III, Legal Metrology (PC) Rules, 2011", "Net Quantity Zone",
             "forbidden_unit"),
    Template("R5a", "LM-PC-005", "CRITICAL", 15000, "mrp", 50, "missing(mrp)", "Maximum Retail Price",
             "MRP declaration missing from package.", _NONE,
             "Maximum Retail Price inclusive of all taxes must be declared (Rule 6(1)(e)).", 98, "Rule 6(1)(e), Legal Metrology (PC) Rules, 2011", "MRP Zone"),
    Template("R5b", "LM-PC-005", "HIGH", 5000, "mrp", 25, "present(mrp) AND NOT tax_phrase", "Maximum Retail Price",
             "Mandatory statement '(Inclusive of all taxes)' missing from MRP declaration.", "trim(mrp_raw)",
             "MRP must unambiguously state 'Inclusive of all taxes' or 'Incl. of all taxes' (Rule 6(1)(e)).", 93, "Rule 6(1)(e), Legal Metrology (PC) Rules, 2011", "MRP Zone"),
    Template("R6", "LM-PC-006", "HIGH", 5000, "mandatory", 20, "missing(manufacturing_date)", "Date of Manufacture / Packing",
             "Month and year of manufacture or pre-packing missing.", _NONE,
             "Month and year of manufacture/packing must be clearly stated (Rule 6(1)(d)).", 95, "Rule 6(1)(d), Legal Metrology (PC) Rules, 2011", "Date / Batch Zone"),
    Template("R7a", "LM-PC-007", "HIGH", 5000, "care", 50, "missing(consumer_care)", "Consumer Care Grievance",
             "Consumer care details missing from package.", _NONE,
             "Consumer care telephone helpline and email ID required (Rule 6(1)(n)).", 95, "Rule 6(1)(n), Legal Metrology (PC) Rules, 2011", "Consumer Care Zone"),
    Template("R7b", "LM-PC-007", "MEDIUM", 2500, "care", 25, "present(consumer_care) AND NOT (has_phone AND has_email)", "Consumer Care Grievance",
             "Consumer care grievance cell incomplete: missing {}.", "trim(consumer_care_raw)",
             "Both a telephone helpline and an email address must be provided for consumer grievance (Rule 6(1)(n)).", 90, "Rule 6(1)(n), Legal Metrology (PC) Rules, 2011", "Consumer Care Zone",
             "CASE WHEN NOT has_phone THEN 'phone number' ELSE 'email address' END"),
    Template("R8", "LM-PC-008", "HIGH", 5000, "traceability", 25, "missing(country_of_origin)", "Country of Origin",
             "Country of origin / manufacture not stated on commodity.", _NONE,
             "Country of origin is mandatory on all packaged commodities (Rule 6(1)(f)).", 92, "Rule 6(1)(f), Legal Metrology (PC) Rules, 2011", "Origin Zone"),
]


def condition(template: Template) -> str:
    """The template's condition over the wide row; the same words serve as SQL elsewhere."""
    out = template.holds
    for f in FIELDS:
        out = out.replace(f"missing({f})", f"coalesce({f}_missing, TRUE)").replace(f"present({f})", f"NOT coalesce({f}_missing, TRUE)")
    return out


def _missing(value: Column, status: Column) -> Column:
    return (F.coalesce(value, F.lit("")) == "") | (F.coalesce(status, F.lit("MISSING")) == "MISSING")


def wide(fields: DataFrame, key: str | list[str] = "image_id") -> DataFrame:
    """Long fields (the key's columns, field_name, value, raw_text, status) to one row a key.

    A field is missing if its value is null or empty, or its status is MISSING or null; a field without a row is missing.
    """
    missing = _missing(F.col("value"), F.col("status"))
    pivoted = fields.groupBy(*([key] if isinstance(key, str) else key)).pivot("field_name", FIELDS).agg(
        F.first("value").alias("value"), F.first(F.coalesce("raw_text", F.lit(""))).alias("raw"), F.first(missing).alias("missing"))
    return marked(pivoted)


def spread(rows: DataFrame) -> DataFrame:
    """Wide rows as of ``wide``, with all other columns, from rows that have each of FIELDS as a struct (value, raw_text, status), null where there is no such field."""
    cols = {}
    for f in FIELDS:
        is_there, x = F.col(f).isNotNull(), F.col(f)
        cols |= {f"{f}_value": x["value"], f"{f}_raw": F.when(is_there, F.coalesce(x["raw_text"], F.lit(""))), f"{f}_missing": F.when(is_there, _missing(x["value"], x["status"]))}
    return marked(rows.withColumns(cols))


def marked(rows: DataFrame) -> DataFrame:
    """Wide rows (x_value, x_raw, x_missing of each field x) with what the templates ask of the raw texts."""
    raw = lambda f: F.coalesce(f"{f}_raw", F.lit(""))
    return rows.withColumns({
        "forbidden_unit": S.forbidden_unit(raw("net_quantity")), "tax_phrase": S.has_tax_phrase(raw("mrp")),
        "has_phone": S.has_phone(raw("consumer_care")), "has_email": S.has_email(raw("consumer_care"))})


def _document(t: Template) -> Column:
    said = F.lit(t.issue)
    if t.names:
        before, after = t.issue.split("{}")
        said = F.concat(F.lit(before), F.expr(t.names), F.lit(after))
    return F.struct(
        F.lit(t.name).alias("template"), F.lit(t.rule_code).alias("rule_code"), F.lit(t.category).alias("category"), said.alias("issue"), F.expr(t.detected).alias("detected_value"),
        F.lit(t.expected).alias("expected_requirement"), F.lit(t.severity).alias("severity"), F.lit(t.confidence).cast("long").alias("confidence"),
        F.lit(t.legal_reference).alias("legal_reference"), F.lit(t.zone).alias("evidence_zone"), F.lit(t.amount).cast("long").alias("amount"))


def found() -> Column:
    """The violations of a wide row as an array of whole documents, in the templates' order."""
    return F.filter(F.array(*(F.when(F.expr(condition(t)), _document(t)) for t in TEMPLATES)), lambda v: v.isNotNull())


def documents(wide_rows: DataFrame, key: str | list[str] = "image_id") -> DataFrame:
    """The violations of a wide row as whole documents, in the templates' order: the key's columns, place (from 0), and a template's columns."""
    keys = [key] if isinstance(key, str) else key
    return wide_rows.select(*keys, F.posexplode(found()).alias("place", "v")).select(*keys, F.col("place").cast("long").alias("place"), "v.*")


def violations(wide_rows: DataFrame, key: str = "image_id") -> DataFrame:
    """Which violations there are, without their words."""
    return documents(wide_rows, key).select(key, "template", "rule_code", "severity", "amount")


def evaluate(wide_rows: DataFrame, key: str | list[str] = "image_id") -> DataFrame:
    """One row a wide row, with the key's columns: components, score in tenths (half to even, of exact hundredths), status, counts, fee and whether to prosecute."""
    hit = {t.name: F.when(F.expr(condition(t)), 1).otherwise(0) for t in TEMPLATES}
    total = lambda keep, of: sum((hit[t.name] * of(t) for t in TEMPLATES if keep(t)), F.lit(0))
    rows = wide_rows.select(
        *([key] if isinstance(key, str) else key), *((F.lit(100) - total(lambda t, c=c: t.component == c, lambda t: t.deduction)).alias(c) for c in WEIGHTS),
        total(lambda t: t.severity == "CRITICAL", lambda t: 1).alias("critical_violations"), total(lambda t: t.severity == "HIGH", lambda t: 1).alias("high_violations"),
        total(lambda t: True, lambda t: 1).alias("violations_count"), total(lambda t: True, lambda t: t.amount).alias("estimated_fee"))
    return finish(rows).hint("merge")  # a row an image, of fields that Spark takes for far fewer than they are


def finish(rows: DataFrame) -> DataFrame:
    """Score, status and prosecution from the components and counts."""
    hundredths = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0))
    tenths = F.floor(hundredths / 10)
    rest = hundredths % 10
    even = tenths + F.when((rest > 5) | ((rest == 5) & (tenths % 2 == 1)), 1).otherwise(0)
    status = (F.when((F.col("critical_violations") + F.col("high_violations")) > 0, "NON_COMPLIANT").when(F.col("violations_count") > 0, "NEEDS_MANUAL_VERIFICATION").otherwise("COMPLIANT"))
    return rows.withColumn("score_tenths", even.cast("long")).withColumns({
        "compliance_status": status, "prosecution_recommended": (F.col("critical_violations") >= 2) | (F.col("score_tenths") < 500)})
