"""Scalar functions over label lines, documents and inspections."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions import scalars as S
from shelfmark.sources import labels
from shelfmark.sources import registry_views as views
from shelfmark.sources.tables import table

_lines = labels.label_lines
_of = lambda spark, d, kind: _lines(spark, d).where(F.col("kind") == kind)
T = lambda: F.col("text")


def sql_any(words: list[str], text: str = "text") -> str:
    return f"regexp_matches(upper({text}), '{P.any_of(words)}')"


UNIT_SQL = "CASE " + " ".join("WHEN {u} IN (" + ", ".join(f"'{w}'" for w in words) + f") THEN '{name}'" for name, words in P.UNITS.items()) + " ELSE {u} END"
_QUANTITY = r"(?i)\b(\d+(\.\d+)?)\s*(" + "|".join(P.UNIT_WORDS) + r")\b"
CURRENCY_SQL = "CASE " + " ".join(f"WHEN {sql_any(signs, '{t}')} THEN '{name}'" for name, signs in P.CURRENCIES) + " ELSE 'INR' END"
#: Value and unit of a text as SQL, {t} for the text. The quantity's pattern goes without look-around, which no text here needs.
_q = lambda g: "regexp_extract({t}, '" + _QUANTITY + f"', {g})"
QUANTITY_SQL = ("CASE WHEN NOT regexp_matches({t}, '" + P.DIMENSION + "') THEN TRY_CAST(nullif(" + _q(1) + ", '') AS DOUBLE) END",
                "CASE WHEN NOT regexp_matches({t}, '" + P.DIMENSION + "') AND " + _q(1) + " <> '' THEN " + UNIT_SQL.replace("{u}", "lower(trim(" + _q(3) + "))") + " END")
_price = "TRY_CAST(nullif(replace(regexp_extract(regexp_replace({t}, '" + P.NOT_A_PRICE + "', '', 'g'), '" + P.PRICE + "', 1), ',', '.'), '') AS DOUBLE)"
MRP_SQL = ("CASE WHEN " + _price + " BETWEEN 0.1 AND 100000 THEN " + _price + " END", "CASE WHEN " + _price + " BETWEEN 0.1 AND 100000 THEN " + CURRENCY_SQL + " END")
_day = "regexp_extract({t}, '" + P.DAY_MONTH_YEAR + "', 0)"
_my = lambda g: "regexp_extract({t}, '" + P.MONTH_YEAR[0] + f"', {g})"
_year = "CASE WHEN length(" + _my(2) + ") = 2 THEN '20' || " + _my(2) + " ELSE " + _my(2) + " END"
_rel = lambda g: "regexp_extract({t}, '" + P.RELATIVE + f"', {g})"
DATE_SQL = ("CASE WHEN " + _day + " <> '' THEN regexp_replace(" + _day + ", '[-.]', '/', 'g') WHEN " + _my(1) + " <> '' THEN upper(substr(" + _my(1) + ", 1, 3)) || ' ' || " + _year
            + " WHEN " + _rel(2) + " <> '' THEN " + _rel(2) + " || ' ' || lower(" + _rel(3) + ") END",
            "CASE WHEN " + _day + " <> '' THEN 'exact_date' WHEN " + _my(1) + " <> '' THEN 'month_year' WHEN " + _rel(2) + " <> '' THEN 'relative_duration' END")
_left = "trim(regexp_replace(regexp_replace({t}, '(?i)" + P.LABELS["batch"] + "', '', 'g'), '[:.]', '', 'g'))"
CLEAN_BATCH_SQL = "CASE WHEN length(" + _left + ") >= 3 AND NOT " + sql_any(P.BATCH_REJECTS, _left) + " THEN " + _left + " END"
BATCH_VALUE_SQL = "CASE WHEN length(trim({t})) >= 3 AND regexp_matches(trim({t}), '\\d') AND NOT " + sql_any(P.BATCH_VALUE_REJECTS, "trim({t})") + " THEN trim({t}) END"
_at = lambda sql, t="text": sql.replace("{t}", t)


def _parsed(parse, kind=None):
    def query(spark, d):
        lines = _lines(spark, d) if kind is None else _of(spark, d, kind)
        return lines.withColumn("v", parse(T())).select("image_id", "line", "text", F.col("v.value").alias("value"), F.col("v.unit").alias("unit"))

    return query


def _parsed_sql(pair: tuple[str, str], kind: str | None = None) -> str:
    where = f" WHERE kind = '{kind}'" if kind else ""
    return labels.with_views(f"SELECT image_id, line, text, {_at(pair[0])} AS value, {_at(pair[1])} AS unit FROM v_lines{where}")


def _digests(spark, d, with_fee: bool):
    seen = views.inspections(spark, d).join(views.violations(spark, d).groupBy("inspection_id").agg(F.count(F.lit(1)).alias("n")), "inspection_id", "left")
    number = F.concat(F.lit("INSP-2026-"), F.upper(F.substring(F.sha2(F.col("inspection_id").cast("string"), 256), 1, 6)))
    parts = [number, F.coalesce(F.col("store_id").cast("string"), F.lit("NONE")), F.col("compliance_status"), F.coalesce("n", F.lit(0)).cast("string")]
    return seen.select("inspection_id", number.alias("inspection_number"), S.record_digest(*parts, *([F.col("fee").cast("string")] if with_fee else [])).alias("digest"))


_digest_sql = lambda more="": views.with_views(f"""SELECT i.inspection_id, 'INSP-2026-' || upper(substr(sha256(CAST(i.inspection_id AS VARCHAR)), 1, 6)) AS inspection_number,
    sha256('INSP-2026-' || upper(substr(sha256(CAST(i.inspection_id AS VARCHAR)), 1, 6)) || '|' || coalesce(CAST(store_id AS VARCHAR), 'NONE') || '|' || compliance_status || '|' || coalesce(n, 0){more}) AS digest
    FROM v_inspections i LEFT JOIN (SELECT inspection_id, count(*) AS n FROM v_violations GROUP BY 1) v ON v.inspection_id = i.inspection_id""")  # noqa: E731


def _evidence(spark, d):
    key, digest = F.col("doc_id"), S.verify_evidence(T(), F.lit(""))["computed_hash"]
    claimed = F.when(key % 4 == 0, "").when(key % 4 == 1, F.upper(digest)).when(key % 4 == 2, digest).otherwise(F.sha2(F.concat(T(), F.lit("x")), 256))
    return table(spark, d, "documents").withColumn("v", S.verify_evidence(T(), claimed)).select("doc_id", "v.*")


def _replies(spark, d):
    """A model's replies made from the events' JSON: fenced as JSON, fenced, bare, or cut off."""
    k = F.col("event_id")
    fenced = lambda mark: F.concat(F.lit("Here it is: " + mark + "\n"), F.col("props"), F.lit("\n``` done"))
    reply = F.when(k % 4 == 0, fenced("```json")).when(k % 4 == 1, fenced("```")).when(k % 4 == 2, F.concat(F.lit(" "), F.col("props"), F.lit(" "))).otherwise(F.expr("left(props, length(props) - 1)"))
    return table(spark, d, "events").select(k.alias("reply_id"), reply.alias("reply"))


_REPLIES_SQL = """SELECT event_id AS reply_id, CASE event_id % 4 WHEN 0 THEN 'Here it is: ```json' || chr(10) || props || chr(10) || '``` done' WHEN 1 THEN 'Here it is: ```' || chr(10) || props || chr(10) || '``` done'
    WHEN 2 THEN ' ' || props || ' ' ELSE left(props, length(props) - 1) END AS reply FROM events"""

QUERIES = {
    "q_normalize_unit": lambda spark, d: _of(spark, d, "quantity").select("image_id", F.split("value", " ").getItem(F.size(F.split("value", " ")) - 1).alias("raw")).withColumn("unit", S.normalize_unit(F.col("raw"))),
    "q_normalize_currency": lambda spark, d: _lines(spark, d).select("image_id", "line", S.normalize_currency(T()).alias("currency")),
    "q_parse_quantity": _parsed(S.parse_quantity),
    "q_parse_mrp": _parsed(S.parse_mrp),
    "q_parse_date": _parsed(S.parse_date),
    "q_batch_clean": lambda spark, d: _lines(spark, d).select("image_id", "line", S.clean_batch(T()).alias("same_line"), S.batch_value(T()).alias("own_line")),
    "q_label_classes": lambda spark, d: _lines(spark, d).select("image_id", "line", *(S.found(T(), p).alias(f"is_{k}") for k, p in P.LABELS.items())),
    "q_other_declarations": lambda spark, d: _lines(spark, d).select("image_id", "line", S.other_declaration(T()).alias("declaration")).where("declaration IS NOT NULL"),
    "q_non_english": lambda spark, d: table(spark, d, "documents").select("doc_id", S.is_non_english(T()).alias("is_non_english")),
    "q_contact_presence": lambda spark, d: table(spark, d, "documents").select("doc_id", S.has_phone(T()).alias("has_phone"), S.has_email(T()).alias("has_email")),
    "q_unit_and_tax_phrases": lambda spark, d: _lines(spark, d).select("image_id", "line", S.forbidden_unit(T()).alias("forbidden_unit"), S.has_tax_phrase(T()).alias("has_tax_phrase")),
    "q_record_digest": lambda spark, d: _digests(spark, d, False),
    "q_report_digest": lambda spark, d: _digests(spark, d, True),
    "q_evidence_verify": _evidence,
    "q_fenced_json": lambda spark, d: _replies(spark, d).select("reply_id", S.unfenced(F.col("reply")).alias("body")).withColumn("is_json", S.is_json(F.col("body"))),
}

ORACLES = {
    "q_normalize_unit": labels.with_views("SELECT image_id, raw, " + UNIT_SQL.replace("{u}", "lower(trim(raw))") + " AS unit FROM (SELECT image_id, string_split(value, ' ')[-1] AS raw FROM v_lines WHERE kind = 'quantity')"),
    "q_normalize_currency": labels.with_views(f"SELECT image_id, line, {_at(CURRENCY_SQL)} AS currency FROM v_lines"),
    "q_parse_quantity": _parsed_sql(QUANTITY_SQL),
    "q_parse_mrp": _parsed_sql(MRP_SQL),
    "q_parse_date": _parsed_sql(DATE_SQL),
    "q_batch_clean": labels.with_views(f"SELECT image_id, line, {_at(CLEAN_BATCH_SQL)} AS same_line, {_at(BATCH_VALUE_SQL)} AS own_line FROM v_lines"),
    "q_label_classes": labels.with_views("SELECT image_id, line, " + ", ".join(f"regexp_matches(text, '(?i){p}') AS is_{k}" for k, p in P.LABELS.items()) + " FROM v_lines"),
    "q_other_declarations": labels.with_views("SELECT * FROM (SELECT image_id, line, CASE " + " ".join(f"WHEN {sql_any(words)} THEN '{name}: ' || text" for name, words in P.OTHER) + " END AS declaration FROM v_lines) WHERE declaration IS NOT NULL"),
    "q_non_english": "SELECT doc_id, regexp_matches(text, '[ऀ-ൿ؀-ۿ一-鿿]') AS is_non_english FROM documents",
    "q_contact_presence": f"SELECT doc_id, regexp_matches(text, '{P.PHONE}') AS has_phone, regexp_matches(text, '{P.EMAIL}') AS has_email FROM documents",
    "q_unit_and_tax_phrases": labels.with_views("SELECT image_id, line, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '\\b{u}\\b') THEN '{u}'" for u in P.FORBIDDEN_UNITS)
                                               + f" END AS forbidden_unit, regexp_matches(lower(text), '{P.TAX_PHRASE}') AS has_tax_phrase FROM v_lines"),
    "q_record_digest": _digest_sql(),
    "q_report_digest": _digest_sql(" || '|' || CAST(fee AS VARCHAR)"),
    "q_evidence_verify": """SELECT doc_id, CASE WHEN regexp_matches(text, '[^\\x{00}-\\x{FF}]') THEN sha256(text)
        ELSE sha256(unhex(array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c = '' THEN '' ELSE printf('%02X', unicode(c)) END), ''))) END AS computed_hash,
        CASE doc_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE ELSE FALSE END AS is_tamper_free FROM documents""",
    "q_fenced_json": "SELECT *, json_valid(body) AS is_json FROM (SELECT reply_id, regexp_replace(CASE WHEN contains(reply, '```json') THEN string_split(string_split(reply, '```json')[2], '```')[1] "
                     "WHEN contains(reply, '```') THEN string_split(reply, '```')[2] ELSE reply END, '^\\s+|\\s+$', '', 'g') AS body FROM (" + _REPLIES_SQL + "))",
}
