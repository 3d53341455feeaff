"""Fixed dimensions: the statutory rules and the traceability matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The rules in force.
_PCR = "Legal Metrology (Packaged Commodities) Rules, 2011"
RULES = [
    ("LM-PC-001", "Product Identification", "CRITICAL", f"Rule 6(1)(a), {_PCR}"),
    ("LM-PC-002", "Manufacturer Details", "HIGH", f"Rule 6(1)(b), {_PCR}"),
    ("LM-PC-003", "Manufacturer Address", "HIGH", f"Rule 6(1)(b), {_PCR}"),
    ("LM-PC-004", "Net Quantity & Standard Units", "CRITICAL", f"Rule 6(1)(c) & Rule 12, {_PCR}"),
    ("LM-PC-005", "MRP Declaration", "CRITICAL", f"Rule 6(1)(e), {_PCR}"),
    ("LM-PC-006", "Manufacturing Date", "HIGH", f"Rule 6(1)(d), {_PCR}"),
    ("LM-PC-007", "Consumer Care Details", "HIGH", f"Rule 6(1)(n), {_PCR}"),
    ("LM-PC-008", "Country of Origin", "HIGH", f"Rule 6(1)(f), {_PCR}"),
    ("LM-PC-009", "Unit Sale Price (USP)", "MEDIUM", f"Rule 6(11), {_PCR} (Amendment 2022)"),
    ("LM-PC-010", "Readability & Font Size", "MEDIUM", f"Rule 12 & Schedule III, {_PCR}"),
]
RULE_COLUMNS = ("rule_code", "category", "severity", "legal_reference")
# What each declaration rests on.
_ACT, _FIRST, _48 = "Section 18(1), Legal Metrology Act, 2009", "Section 36(1) — Fine up to ₹25,000", "Section 48(1)"
TRACEABILITY_COLUMNS = ("declaration", "act_section", "rule_clause", "gazette_reference", "offence_category", "punitive_section", "compounding_eligible", "compounding_section")
TRACEABILITY = [
    ("Generic / Common Name", _ACT, f"Rule 6(1)(a), {_PCR}", "G.S.R. 202(E) dated 07.03.2011", "Omission of Statutory Commodity Identity",
     f"{_FIRST} (1st), ₹50,000 (2nd), ₹1,00,000 or 1 year jail (subsequent)", True, f"{_48} of Legal Metrology Act, 2009"),
    ("Manufacturer / Packer Name & Complete Address", _ACT, f"Rule 6(1)(b), {_PCR}", "G.S.R. 202(E) as amended by G.S.R. 779(E)",
     "Defective Traceability / Missing Manufacturer Contact", f"{_FIRST} (1st), ₹50,000 (2nd)", True, f"{_48} of Legal Metrology Act, 2009"),
    ("Net Quantity in Standard SI Units", "Section 18(1) read with Section 8(1), Legal Metrology Act, 2009", "Rule 6(1)(c) & Rule 12 & Schedule III, LM PCR 2011",
     "G.S.R. 202(E) & Weights and Measures Standard Schedule", "Use of Non-Standard Units / False Quantity Declaration",
     "Section 36(1) & Section 29 — Fine up to ₹25,000", True, f"{_48} of Legal Metrology Act, 2009"),
    ("Month & Year of Manufacture / Packing", _ACT, f"Rule 6(1)(d), {_PCR}", "G.S.R. 202(E)", "Omission of Packaging/Manufacturing Date", _FIRST, True, _48),
    ("Maximum Retail Price (MRP) with (Inclusive of all taxes)", "Section 18(1) read with Section 36, Legal Metrology Act, 2009", f"Rule 6(1)(e) & Rule 18(2), {_PCR}",
     "G.S.R. 202(E) & Consumer Protection Notifications", "Dual MRP / Omission of Tax Inclusive Statement / Overcharging",
     "Section 36(1) & Section 36(2) — Fine up to ₹50,000", True, _48),
    ("Consumer Care Helpline & Email", _ACT, f"Rule 6(1)(n), {_PCR}", "G.S.R. 426(E) dated 23.06.2017", "Deprivation of Consumer Grievance Redressal Mechanism", _FIRST, True, _48),
    ("Country of Origin / Manufacture", _ACT, f"Rule 6(1)(f), {_PCR}", "G.S.R. 779(E) dated 02.11.2021", "Omission of Country of Origin on Packaging / E-commerce", _FIRST, True, _48),
    ("Unit Sale Price (USP)", _ACT, f"Rule 6(11), {_PCR}", "G.S.R. 779(E) effective from 01.12.2022", "Non-display of Unit Sale Price per g/kg/ml/l", _FIRST, True, _48),
    ("Batch / Lot / Code Number", _ACT, f"Rule 6(1)(d), {_PCR}", "G.S.R. 202(E) dated 07.03.2011", "Omission of Production Identification and Traceability Code", _FIRST, True, _48),
    ("Best Before / Expiry / Use By Date", f"{_ACT} read with Food Safety Act", "Rule 6(1)(d) & FSSAI Packaging & Labelling Regulations, 2011",
     "F. No. P. 15025/24/2012-PA/FSSAI", "Distribution of Expired / Unsafe Packaged Commodities", "Section 36(1) & FSS Act Section 59", False,
     "Not compoundable if food safety compromised"),
    ("Dimensions / Sizes of Commodity", _ACT, f"Rule 13 & Schedule II, {_PCR}", "G.S.R. 202(E) dated 07.03.2011",
     "Failure to declare length/breadth/thickness in standard metric units", _FIRST, True, _48),
    ("Vegetarian / Non-Vegetarian Logo", f"{_ACT} read with FSS Regulations", "Rule 6 & FSSAI Labelling Regulation 2.2.2(4)",
     "Gazette Notification F.No. 1-94/FSSAI/SP(L&C)/2020", "Misleading Dietary Nature / Logo Dimension Deficiencies", "Section 36(1) & Section 52 of FSS Act", True, _48),
]


#: The fields that rows of the matrix are about.
FIELDS_OF = {"Generic / Common Name": ["product_name"], "Manufacturer / Packer Name & Complete Address": ["manufacturer_name", "manufacturer_address"], "Net Quantity in Standard SI Units": ["net_quantity"],
             "Month & Year of Manufacture / Packing": ["manufacturing_date"], "Maximum Retail Price (MRP) with (Inclusive of all taxes)": ["mrp"], "Consumer Care Helpline & Email": ["consumer_care"],
             "Country of Origin / Manufacture": ["country_of_origin"], "Batch / Lot / Code Number": ["batch_number"], "Best Before / Expiry / Use By Date": ["expiry_date"]}


def rules(spark: SparkSession) -> DataFrame:
    """The rules with ``rule_id``, their place in the list from 1."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(RULES, 1)], ", ".join(f"{c} string" for c in RULE_COLUMNS) + ", rule_id long")


def traceability(spark: SparkSession) -> DataFrame:
    """The matrix, with ``field_names``, the fields that each row is about."""
    rows = [(*r, FIELDS_OF.get(r[0], [])) for r in TRACEABILITY]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'boolean' if c == 'compounding_eligible' else 'string'}" for c in TRACEABILITY_COLUMNS) + ", field_names array<string>")


def _values(rows: list[tuple], columns: tuple[str, ...]) -> str:
    said = lambda v: str(v).upper() if isinstance(v, bool) else f"'{v}'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) t({', '.join(columns)})"


RULES_SQL = _values(RULES, RULE_COLUMNS)
TRACEABILITY_SQL = _values(TRACEABILITY, TRACEABILITY_COLUMNS)
