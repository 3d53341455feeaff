"""Queries that read declarations out of placed text boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions import scalars as S
from shelfmark.operators import analysis, spatial
from shelfmark.plans.rule_queries import scored_views
from shelfmark.plans.text_queries import BATCH_VALUE_SQL, CLEAN_BATCH_SQL, DATE_SQL, MRP_SQL, QUANTITY_SQL, sql_any
from shelfmark.sources import labels
from shelfmark.sources.tables import parts

_boxes = labels.ocr_boxes
_label = lambda kind, t="text": f"regexp_matches({t}, '(?i){P.LABELS[kind]}')"
_GEOMETRY = """SELECT *, sqrt(dx * dx + dy * dy) / height AS norm FROM (SELECT *, (v_x1 + v_x2) / 2.0::DOUBLE - (l_x1 + l_x2) / 2.0::DOUBLE AS dx, (v_y1 + v_y2) / 2.0::DOUBLE - (l_y1 + l_y2) / 2.0::DOUBLE AS dy,
    greatest(10.0::DOUBLE, (greatest(1, l_y2 - l_y1) + greatest(1, v_y2 - v_y1)) / 2.0::DOUBLE) AS height, greatest(greatest(1, l_x2 - l_x1), greatest(1, v_x2 - v_x1)) * 1.5::DOUBLE AS reach FROM {pairs})"""
_RELATION = """SELECT *, CASE WHEN l_idx = v_idx THEN 'SAME_LINE_COMPOSITE' WHEN abs(dy) > abs(dx) AND abs(dy) >= height * 0.5::DOUBLE THEN CASE WHEN abs(dx) > reach THEN 'UNALIGNED_NEIGHBOR' WHEN dy > 0 THEN 'VERTICAL_BELOW'
    ELSE 'VERTICAL_ABOVE' END WHEN abs(dy) <= height * 1.2::DOUBLE THEN CASE WHEN dx > 0 THEN 'HORIZONTAL_RIGHT' WHEN dx < 0 THEN 'HORIZONTAL_LEFT' ELSE 'UNALIGNED_NEIGHBOR' END
    WHEN norm <= 5 THEN 'GRID_TABLE_CELL' ELSE 'UNALIGNED_NEIGHBOR' END AS relation FROM (""" + _GEOMETRY + ")"
_off = lambda best, by, of: f"greatest(0.2::DOUBLE, {best}::DOUBLE - abs({by}) / {of})"
_RANKED = ("SELECT *, CAST(round((0.35::DOUBLE * greatest(0.05::DOUBLE, exp(-norm / 4.0::DOUBLE)) + 0.30::DOUBLE * CASE relation WHEN 'VERTICAL_BELOW' THEN " + _off(1.0, "dx", "reach") + " WHEN 'VERTICAL_ABOVE' THEN "
           + _off(0.85, "dx", "reach") + " WHEN 'HORIZONTAL_RIGHT' THEN " + _off(1.0, "dy", "(height * 1.2::DOUBLE)") + " WHEN 'HORIZONTAL_LEFT' THEN " + _off(0.9, "dy", "(height * 1.2::DOUBLE)")
           + " WHEN 'GRID_TABLE_CELL' THEN 0.65::DOUBLE ELSE 0.5::DOUBLE END + 0.20::DOUBLE * CASE relation " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in spatial.MULTIPLIERS.items())
           + f" END + 0.15::DOUBLE * least(1.0::DOUBLE, v_confidence)) * 1000) AS BIGINT) AS milli FROM ({_RELATION}) WHERE norm <= {spatial.FARTHEST}")
_SIDE = lambda p: ", ".join(f"{p}.{c} AS {p}_{c}" for c in ("idx", "text", "x1", "y1", "x2", "y2", "confidence"))


def _pairs(label_where: str, value_where: str, extra: str = "") -> str:
    return f"(SELECT l.image_id, {_SIDE('l')}, {_SIDE('v')}{extra} FROM v_seen l JOIN v_seen v ON l.image_id = v.image_id AND l.idx <> v.idx WHERE {label_where} AND {value_where})"


def _extract_sql(kind: str, own: tuple[str, str], near: tuple[str, str], cap: float, label_ok: str = "TRUE", fallback: tuple[str, float, str] | None = None, unit: str = "unit", more: str = "") -> str:
    at = lambda sql: sql.replace("{t}", "text")
    seen = f"SELECT *, CAST({at(own[0])} AS VARCHAR) AS own_value, {at(own[1])} AS own_unit, CAST({at(near[0])} AS VARCHAR) AS near_value, {at(near[1])} AS near_unit, {_label(kind)} AND {label_ok} AS is_label FROM v_boxes"
    every = f"""SELECT image_id, 0 AS o0, idx AS o1, 0 AS o2, 0 AS o3, idx AS o4, own_value AS value, own_unit AS unit, 'SAME_LINE_COMPOSITE' AS relation, CAST(round(least({cap}::DOUBLE, confidence * 1.05::DOUBLE) * 1000) AS BIGINT) AS milli,
        idx AS l_idx, idx AS v_idx, text AS label FROM v_seen WHERE is_label AND own_value IS NOT NULL UNION ALL SELECT image_id, 0, l_idx, 1, -milli, v_idx, v_value, v_unit, relation, milli, l_idx, v_idx, l_text FROM ({_RANKED.replace('{pairs}', _pairs('l.is_label', 'v.near_value IS NOT NULL', ', v.near_value AS v_value, v.near_unit AS v_unit'))})"""
    if fallback:
        every += f" UNION ALL SELECT image_id, 1, idx, 0, 0, idx, near_value, near_unit, '{fallback[2]}', CAST(round(confidence * {fallback[1]}::DOUBLE * 1000) AS BIGINT), NULL, idx, NULL FROM v_seen WHERE near_value IS NOT NULL AND {fallback[0]}"
    return labels.with_views(f"""SELECT image_id, value, {unit} AS unit, relation, milli, CAST(l_idx AS BIGINT) AS l_idx, CAST(v_idx AS BIGINT) AS v_idx, label,
        CASE WHEN milli >= 400 THEN 'CONFIRMED' ELSE 'LOW_CONFIDENCE' END AS status{more} FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY o0, o1, o2, o3, o4) AS rn
        FROM ({every})) WHERE rn = 1""", {"v_seen": seen})


_first_sql = lambda where, order: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS rn FROM v_boxes WHERE {where}) WHERE rn = 1)"
_left_sql = lambda kind: f"nullif(trim(replace(regexp_replace(text, '(?i){P.LABELS[kind]}', '', 'g'), ':', '')), '')"
_SEEN = {"v_seen": "SELECT *, " + QUANTITY_SQL[0].replace("{t}", "text") + " AS q FROM v_boxes"}
_DATE_CODE = "'code'"


def _all_relations(spark, d):
    b = _boxes(spark, d)
    pairs = spatial.with_relation(spatial.side(b, "l").join(spatial.side(b, "v"), "image_id"))
    return pairs.select("image_id", F.col("l_idx").cast("long").alias("l_idx"), F.col("v_idx").cast("long").alias("v_idx"), "relation")


def _quantity_pairs(spark, d):
    boxes = spatial.measured(_boxes(spark, d))
    return boxes.where(S.found(F.col("text"), P.LABELS["quantity"])), boxes.where(S.parse_quantity(F.col("text")).isNotNull())


_ids = lambda df: df.select(*(F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in df.dtypes))

def _codes(spark, d):
    """Decoded codes of two thirds of the images, two each."""
    k, code = F.col("p_partkey"), lambda seq, kind, lead: F.struct(F.lit(seq).alias("seq"), kind.alias("type"), F.concat(F.lit(lead), F.col("p_partkey").cast("string")).alias("data"))
    both = F.array(code(2, F.lit("QR"), "x"), code(1, F.when(k % 2 == 0, "EAN13").otherwise("QR"), "890"))
    return parts(spark, d).where(k % 3 != 0).select(k.alias("image_id"), F.explode(both).alias("c")).select("image_id", "c.*")


def _analyzed(spark, d):
    return analysis.analyzed(_boxes(spark, d), _codes(spark, d))


def _foreign(spark, d):
    k = (F.col("image_id") + F.col("idx")) % 5
    return _boxes(spark, d).withColumn("text", F.when(k == 0, "देश भारत").when(k == 1, "मूल्य").when(k == 2, "Crème brûlée").otherwise(F.col("text")))


QUERIES = {
    "q_spatial_relation": _all_relations,
    "q_candidate_rank": lambda spark, d: _ids(spatial.ranked(*_quantity_pairs(spark, d))),
    **{f"q_extract_{k}": (lambda spark, d, f=f: f(_boxes(spark, d))) for k, f in (
        ("quantity", spatial.quantity), ("mrp", spatial.mrp), ("batch", spatial.batch), ("mfg_date", spatial.mfg_date), ("expiry", spatial.expiry), ("manufacturer", spatial.manufacturer),
        ("product", spatial.product), ("care", spatial.care), ("origin", spatial.origin), ("other", spatial.other))},
    "q_analyzed_fields": lambda spark, d: analysis.entries(_analyzed(spark, d)).withColumn("bounding_box", F.to_json("bounding_box")),
    "q_analyze_evidence": lambda spark, d: analysis.evaluated(_analyzed(spark, d)),
    "q_reading_order": lambda spark, d: spatial.reading_order(_boxes(spark, d)),
    "q_layout_order": lambda spark, d: spatial.reading_order(_boxes(spark, d), 30),
    "q_barcode_field": lambda spark, d: spatial.barcode(_boxes(spark, d), _codes(spark, d)),
    "q_translated_boxes": lambda spark, d: spatial.translated(_foreign(spark, d), spark.createDataFrame([("देश भारत", "Country India")], "text string, translation string")),
    "q_transcript": lambda spark, d: spatial.transcript(_boxes(spark, d)),
}

def _analyzed_sql() -> dict[str, str]:
    """v_analyzed: the fourteen entries, put together from the oracles of the single extractors and the boxes they name."""
    five = {k: ORACLES[f"q_extract_{k}"] for k in ("quantity", "mrp", "batch", "mfg_date", "expiry")}
    box = lambda b: f"'[' || {b}.x1 || ',' || {b}.y1 || ',' || {b}.x2 || ',' || {b}.y2 || ']'"
    milli = lambda b, by="": f"CAST(round({b}.confidence{by} * 1000) AS BIGINT)"
    zero, out = "'[0,0,0,0]'", []
    for k, name, detail, none in (("quantity", "net_quantity", "e.unit", "NULL"), ("mrp", "mrp", "e.unit", "NULL"), ("batch", "batch_number", "NULL", "NULL"),
                                  ("mfg_date", "manufacturing_date", "e.date_type", "'unknown'"), ("expiry", "expiry_date", "e.unit", "'unknown'")):
        raw = f"CASE WHEN e.l_idx IS NOT NULL AND e.l_idx <> e.v_idx THEN e.label || '{' | ' if k == 'mrp' else ' -> '}' || v.text ELSE v.text END"
        out.append(f"""SELECT i.image_id, '{name}' AS field_name, e.value, {raw} AS raw_text, coalesce(e.milli, 0) AS confidence_milli, coalesce({milli('v')}, 0) AS ocr_milli, CASE WHEN e.value IS NULL THEN 'None' ELSE 'EnsembleOCR' END AS source_model,
            coalesce({box('v')}, {zero}) AS bounding_box, coalesce(e.relation, 'NONE') AS spatial_relationship, coalesce(e.status, 'MISSING') AS status, CASE WHEN e.value IS NULL THEN {none} ELSE {detail} END AS detail
            FROM v_images i LEFT JOIN ({five[k]}) e ON e.image_id = i.image_id LEFT JOIN v_boxes v ON v.image_id = e.image_id AND v.idx = e.v_idx""")
    def single(name: str, value: str, first: str, relation: str, by: str = "", status: str = "'CONFIRMED'") -> str:
        return f"""SELECT i.image_id, '{name}', {value}, b.text, coalesce({milli('b', by)}, 0), coalesce({milli('b', by)}, 0), CASE WHEN b.text IS NULL THEN 'None' ELSE 'EnsembleOCR' END, coalesce({box('b')}, {zero}),
            CASE WHEN b.text IS NULL THEN 'NONE' ELSE '{relation}' END, CASE WHEN b.text IS NULL THEN 'MISSING' ELSE {status} END, NULL FROM v_images i LEFT JOIN {first} b ON b.image_id = i.image_id"""
    maker = _first_sql(_label("manufacturer"), "idx")
    made = "(SELECT b.*, m.name, m.address, m.address_status FROM " + maker + " b JOIN (" + ORACLES["q_extract_manufacturer"] + ") m ON m.image_id = b.image_id)"
    title = _first_sql("length(text) > 3 AND NOT " + sql_any(P.PRODUCT_REJECTS), "y1, x1, idx")
    care = _first_sql("(" + _label("care") + f" OR regexp_matches(text, '{P.any_of(P.CARE_MARKS)}'))", "idx")
    origin = _first_sql(_label("origin"), "idx")
    out += [single("manufacturer_name", "b.name", made, "VERTICAL_STACK_BLOCK"), single("manufacturer_address", "b.address", made, "VERTICAL_STACK_BLOCK", " * 0.9::DOUBLE", "b.address_status"),
            single("product_name", "b.text", title, "TOP_HEADER_PROMINENCE"), single("brand_name", "string_split(b.text, ' ')[1]", title, "TOP_HEADER_PROMINENCE"), single("consumer_care", "b.text", care, "SAME_LINE_COMPOSITE"),
            f"""SELECT i.image_id, 'country_of_origin', o.country, CASE o.relation WHEN 'SAME_LINE_COMPOSITE' THEN b.text WHEN 'INFERRED_FROM_ADDRESS' THEN 'Manufactured in India (Inferred from address)' END,
            CASE o.relation WHEN 'SAME_LINE_COMPOSITE' THEN {milli('b')} WHEN 'INFERRED_FROM_ADDRESS' THEN 850 ELSE 0 END, CASE o.relation WHEN 'SAME_LINE_COMPOSITE' THEN {milli('b')} WHEN 'INFERRED_FROM_ADDRESS' THEN 850 ELSE 0 END,
            CASE o.relation WHEN 'SAME_LINE_COMPOSITE' THEN 'EnsembleOCR' WHEN 'INFERRED_FROM_ADDRESS' THEN 'SpatialInference' ELSE 'None' END,
            coalesce(CASE o.relation WHEN 'SAME_LINE_COMPOSITE' THEN {box('b')} WHEN 'INFERRED_FROM_ADDRESS' THEN {box('m')} END, {zero}), o.relation, CASE WHEN o.relation = 'NONE' THEN 'MISSING' ELSE 'CONFIRMED' END, NULL
            FROM v_images i JOIN ({ORACLES['q_extract_origin']}) o ON o.image_id = i.image_id LEFT JOIN {origin} b ON b.image_id = i.image_id LEFT JOIN {maker} m ON m.image_id = i.image_id""",
            f"SELECT image_id, 'barcode_or_qr', value, raw_text, milli, milli, 'BarcodeScanner', {zero}, relation, status, NULL FROM ({ORACLES['q_barcode_field']})",
            f"""SELECT i.image_id, 'other_declarations', o.declarations, o.declarations, CASE WHEN o.declarations IS NULL THEN 0 ELSE 800 END, CASE WHEN o.declarations IS NULL THEN 0 ELSE 800 END, 'EnsembleOCR', {zero}, 'DECLARATION_BLOCK',
            CASE WHEN o.declarations IS NULL THEN 'MISSING' ELSE 'CONFIRMED' END, NULL FROM v_images i LEFT JOIN ({ORACLES['q_extract_other']}) o ON o.image_id = i.image_id"""]
    priced = f"""SELECT image_id, 'currency', coalesce(detail, 'INR'), raw_text, CASE WHEN value IS NULL THEN 500 ELSE confidence_milli END, ocr_milli, CASE WHEN value IS NULL THEN 'Default' ELSE source_model END, bounding_box,
        CASE WHEN value IS NULL THEN 'DEFAULT' ELSE spatial_relationship END, CASE WHEN value IS NULL THEN 'LOW_CONFIDENCE' ELSE 'CONFIRMED' END, NULL FROM v_paired WHERE field_name = 'mrp'"""
    return {"v_images": "SELECT DISTINCT image_id FROM v_boxes", "v_paired": " UNION ALL ".join(out), "v_analyzed": f"SELECT * FROM v_paired UNION ALL {priced}",
            "v_judged": "SELECT image_id, field_name, CASE WHEN field_name = 'net_quantity' AND value = '0.0' THEN '' ELSE value END AS value, coalesce(raw_text, '') AS raw_text, status FROM v_analyzed"}


ORACLES = {
    "q_spatial_relation": labels.with_views("SELECT image_id, CAST(l_idx AS BIGINT) AS l_idx, CAST(v_idx AS BIGINT) AS v_idx, relation FROM ("
                                            + _RELATION.replace("{pairs}", f"(SELECT l.image_id, {_SIDE('l')}, {_SIDE('v')} FROM v_boxes l JOIN v_boxes v ON l.image_id = v.image_id)") + ")"),
    "q_candidate_rank": labels.with_views("SELECT image_id, CAST(l_idx AS BIGINT) AS l_idx, row_number() OVER (PARTITION BY image_id, l_idx ORDER BY milli DESC, v_idx) AS rank, CAST(v_idx AS BIGINT) AS v_idx, relation, milli FROM ("
                                          + _RANKED.replace("{pairs}", _pairs(_label("quantity", "l.text"), "v.q IS NOT NULL")) + ")", _SEEN),
    "q_extract_quantity": _extract_sql("quantity", QUANTITY_SQL, QUANTITY_SQL, 0.98, fallback=("NOT " + sql_any(P.QUANTITY_REJECTS), 0.85, "STANDALONE_QUANTITY_MATCH")),
    "q_extract_mrp": _extract_sql("mrp", MRP_SQL, MRP_SQL, 0.99, fallback=(f"regexp_matches(text, '{P.any_of(['₹', 'Rs.', 'RS', 'INR'])}')", 0.88, "STANDALONE_CURRENCY_PRICE")),
    "q_extract_batch": _extract_sql("batch", (CLEAN_BATCH_SQL, _DATE_CODE), (BATCH_VALUE_SQL, _DATE_CODE), 0.96),
    "q_extract_mfg_date": _extract_sql("mfg_date", DATE_SQL, DATE_SQL, 0.98, "NOT " + sql_any(["EXP", "BEST BEFORE", "USE BY"]),
                                        more=", CASE WHEN regexp_matches(upper(label), 'PKD|PACKED|PACKING') THEN 'packing_date' ELSE 'manufacturing_date' END AS date_type"),
    "q_extract_expiry": _extract_sql("expiry", DATE_SQL, DATE_SQL, 0.96, unit="CASE unit WHEN 'relative_duration' THEN unit ELSE 'exact_date' END"),
    "q_extract_manufacturer": labels.with_views(f"""SELECT l.image_id, coalesce(l.name, 'Manufactured on Package') AS name, coalesce(a.address, l.name, 'Manufactured on Package') AS address,
        CASE WHEN a.address IS NOT NULL THEN 'CONFIRMED' ELSE 'LOW_CONFIDENCE' END AS address_status FROM (SELECT *, {_left_sql('manufacturer')} AS name FROM {_first_sql(_label('manufacturer'), 'idx')}) l LEFT JOIN (
        SELECT l.image_id, string_agg(v.text, ', ' ORDER BY v.idx) AS address FROM {_first_sql(_label('manufacturer'), 'idx')} l JOIN v_boxes v ON v.image_id = l.image_id AND v.idx <> l.idx
        WHERE {sql_any(P.PLACES, 'v.text')} AND (v.y1 + v.y2) > (l.y1 + l.y2) AND (v.y1 + v.y2) - (l.y1 + l.y2) <= greatest(1, l.y2 - l.y1) * 10
        AND abs((v.x1 + v.x2) - (l.x1 + l.x2)) <= greatest(1, l.x2 - l.x1, v.x2 - v.x1) * 3 GROUP BY l.image_id) a ON a.image_id = l.image_id"""),
    "q_extract_product": labels.with_views(f"SELECT image_id, text AS product_name, string_split(trim(text), ' ')[1] AS brand_name FROM {_first_sql('length(text) > 3 AND NOT ' + sql_any(P.PRODUCT_REJECTS), 'y1, x1, idx')}"),
    "q_extract_care": labels.with_views(f"SELECT image_id, text AS consumer_care, CAST(idx AS BIGINT) AS idx FROM {_first_sql('(' + _label('care') + f" OR regexp_matches(text, '{P.any_of(P.CARE_MARKS)}'))", 'idx')}"),
    "q_extract_origin": labels.with_views(f"""SELECT h.image_id, coalesce(CASE WHEN l.image_id IS NOT NULL THEN coalesce(l.said, 'India') END, CASE WHEN hint THEN 'India' END) AS country,
        CASE WHEN l.image_id IS NOT NULL THEN 'SAME_LINE_COMPOSITE' WHEN hint THEN 'INFERRED_FROM_ADDRESS' ELSE 'NONE' END AS relation FROM (SELECT image_id,
        bool_or({sql_any(['INDIA', 'PIN', 'DELHI', 'BENGALURU', 'MUMBAI', 'KARNATAKA', 'TAMIL NADU', 'GUJARAT'])}) AS hint FROM v_boxes GROUP BY 1) h LEFT JOIN (SELECT *, {_left_sql('origin')} AS said FROM {_first_sql(_label('origin'), 'idx')}) l ON l.image_id = h.image_id"""),
    "q_extract_other": labels.with_views("SELECT image_id, string_agg(d, '; ' ORDER BY idx) AS declarations FROM (SELECT *, CASE " + " ".join(f"WHEN {sql_any(words)} THEN '{name}: ' || text" for name, words in P.OTHER)
                                         + " END AS d FROM v_boxes) WHERE d IS NOT NULL GROUP BY image_id"),
    "q_reading_order": labels.with_views("SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY floor(y1 / 25), x1, idx) - 1 AS place, CAST(idx AS BIGINT) AS idx, text FROM v_boxes"),
    "q_layout_order": labels.with_views("SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY floor(y1 / 30), x1, idx) - 1 AS place, CAST(idx AS BIGINT) AS idx, text FROM v_boxes"),
    "q_barcode_field": """SELECT p_partkey AS image_id, CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'EAN13' ELSE 'QR' END || ': 890' || p_partkey END AS value,
        CASE WHEN p_partkey % 3 <> 0 THEN '890' || p_partkey END AS raw_text, CAST(CASE WHEN p_partkey % 3 <> 0 THEN 990 ELSE 0 END AS BIGINT) AS milli,
        CASE WHEN p_partkey % 3 <> 0 THEN 'SCANNED_OPTICAL_CODE' ELSE 'NONE' END AS relation, CASE WHEN p_partkey % 3 <> 0 THEN 'CONFIRMED' ELSE 'MISSING' END AS status FROM part""",
    "q_translated_boxes": labels.with_views("""SELECT image_id, CAST(idx AS BIGINT) AS idx, text, text IN ('देश भारत', 'मूल्य') AS is_multilingual, CASE text WHEN 'देश भारत' THEN 'Country India' ELSE text END AS translated_text
        FROM (SELECT image_id, idx, CASE (image_id + idx) % 5 WHEN 0 THEN 'देश भारत' WHEN 1 THEN 'मूल्य' WHEN 2 THEN 'Crème brûlée' ELSE text END AS text FROM v_boxes)"""),
    "q_transcript": labels.with_views("SELECT image_id, string_agg(text, chr(10) ORDER BY floor(y1 / 25), x1, idx) AS transcript FROM v_boxes GROUP BY image_id"),
}
ORACLES["q_analyzed_fields"] = labels.with_views("SELECT * FROM v_analyzed", _analyzed_sql())
ORACLES["q_analyze_evidence"] = labels.with_views("""SELECT s.image_id, n.total_fields, n.confirmed, n.low_confidence, n.missing, n.confidence_sum_milli, s.compliance_status, s.score_tenths, s.critical_violations, s.high_violations,
    s.violations_count, CAST(s.estimated_fee AS BIGINT) AS estimated_fee, s.prosecution_recommended FROM v_scored s JOIN (SELECT image_id, count(*) AS total_fields, count(*) FILTER (status = 'CONFIRMED') AS confirmed,
    count(*) FILTER (status = 'LOW_CONFIDENCE') AS low_confidence, count(*) FILTER (status = 'MISSING') AS missing, CAST(sum(confidence_milli) AS BIGINT) AS confidence_sum_milli FROM v_analyzed GROUP BY 1) n
    ON n.image_id = s.image_id""", _analyzed_sql() | scored_views("v_judged"))
