"""What a violation says, for the oracles: written out once more from the statute's templates, apart from the library's own table."""

from __future__ import annotations

# Template, category, issue ({} is filled in), expected requirement, confidence in hundredths, reference, zone.
WORDS_SQL = """SELECT * FROM (VALUES
    ('R1', 'Product Identity', 'Generic or common name of commodity is missing on the Principal Display Panel.', 'Generic or common name must be prominently displayed (Rule 6(1)(a)).', 96,
     'Rule 6(1)(a), Legal Metrology (PC) Rules, 2011', 'Header / Display Panel'),
    ('R2', 'Manufacturer Traceability', 'Name of manufacturer, packer, or importer missing from package.', 'Name and identity of manufacturer or packer must be stated (Rule 6(1)(b)).', 95,
     'Rule 6(1)(b), Legal Metrology (PC) Rules, 2011', 'Manufacturer Zone'),
    ('R3a', 'Manufacturer Address', 'Complete address of manufacturer or packer missing from package.', 'Complete address with street, city, state and PIN code required (Rule 6(1)(b)).', 92,
     'Rule 6(1)(b), Legal Metrology (PC) Rules, 2011', 'Address Zone'),
    ('R3b', 'Manufacturer Address', 'Incomplete manufacturer address; lacking full postal traceability.', 'Full address enabling postal and regulatory contact must be stated (Rule 6(1)(b)).', 88,
     'Rule 6(1)(b), Legal Metrology (PC) Rules, 2011', 'Address Zone'),
    ('R4a', 'Net Quantity Standard', 'Net quantity declaration missing from package.', 'Net weight or measure must be clearly stated in standard SI units (Rule 6(1)(c)).', 98,
     'Rule 6(1)(c) & Rule 12, Legal Metrology (PC) Rules, 2011', 'Net Quantity Zone'),
    ('R4b', 'Net Quantity Standard', 'Forbidden non-standard unit abbreviation ''{}'' detected in net quantity.', 'Only legal standard symbols permitted: g, kg, ml, l. Forbidden: gm, gms, ltrs (Rule 12).', 94,
     'Rule 12 & Schedule III, Legal Metrology (PC) Rules, 2011', 'Net Quantity Zone'),
    ('R5a', 'Maximum Retail Price', 'MRP declaration missing from package.', 'Maximum Retail Price inclusive of all taxes must be declared (Rule 6(1)(e)).', 98,
     'Rule 6(1)(e), Legal Metrology (PC) Rules, 2011', 'MRP Zone'),
    ('R5b', 'Maximum Retail Price', 'Mandatory statement ''(Inclusive of all taxes)'' missing from MRP declaration.', 'MRP must unambiguously state ''Inclusive of all taxes'' or ''Incl. of all taxes'' (Rule 6(1)(e)).', 93,
     'Rule 6(1)(e), Legal Metrology (PC) Rules, 2011', 'MRP Zone'),
    ('R6', 'Date of Manufacture / Packing', 'Month and year of manufacture or pre-packing missing.', 'Month and year of manufacture/packing must be clearly stated (Rule 6(1)(d)).', 95,
     'Rule 6(1)(d), Legal Metrology (PC) Rules, 2011', 'Date / Batch Zone'),
    ('R7a', 'Consumer Care Grievance', 'Consumer care details missing from package.', 'Consumer care telephone helpline and email ID required (Rule 6(1)(n)).', 95,
     'Rule 6(1)(n), Legal Metrology (PC) Rules, 2011', 'Consumer Care Zone'),
    ('R7b', 'Consumer Care Grievance', 'Consumer care grievance cell incomplete: missing {}.', 'Both a telephone helpline and an email address must be provided for consumer grievance (Rule 6(1)(n)).', 90,
     'Rule 6(1)(n), Legal Metrology (PC) Rules, 2011', 'Consumer Care Zone'),
    ('R8', 'Country of Origin', 'Country of origin / manufacture not stated on commodity.', 'Country of origin is mandatory on all packaged commodities (Rule 6(1)(f)).', 92,
     'Rule 6(1)(f), Legal Metrology (PC) Rules, 2011', 'Origin Zone')) t(template, category, issue, expected_requirement, confidence, legal_reference, evidence_zone)"""


def documents_sql(found: str = "v_found", wide: str = "v_wide") -> str:
    """Violations as whole documents, over the views of the rule engine."""
    filled = "replace(s.issue, '{}', CASE f.template WHEN 'R4b' THEN w.forbidden_unit WHEN 'R7b' THEN CASE WHEN NOT w.has_phone THEN 'phone number' ELSE 'email address' END ELSE '' END)"
    seen = "CASE f.template WHEN 'R3b' THEN w.manufacturer_address_value WHEN 'R4b' THEN trim(w.net_quantity_raw) WHEN 'R5b' THEN trim(w.mrp_raw) WHEN 'R7b' THEN trim(w.consumer_care_raw) ELSE 'Not Detected' END"
    return f"""SELECT f.image_id, row_number() OVER (PARTITION BY f.image_id ORDER BY f.template) - 1 AS place, f.template, f.rule_code, s.category, {filled} AS issue, {seen} AS detected_value,
        s.expected_requirement, f.severity, CAST(s.confidence AS BIGINT) AS confidence, s.legal_reference, s.evidence_zone, CAST(f.amount AS BIGINT) AS amount
        FROM {found} f JOIN {wide} w ON w.image_id = f.image_id JOIN ({WORDS_SQL}) s ON s.template = f.template"""
