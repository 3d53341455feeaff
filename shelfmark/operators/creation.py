"""New inspections and stores as the tables that they add rows to. Numbers and codes come from digests of ids, so a run again gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import fields as field_ops
from shelfmark.operators import rules

#: What a store is given where its request says nothing.
STORE_DEFAULTS = {"store_name": "Retail Store", "address": "Market Area", "city": "Bengaluru", "state": "Karnataka", "pincode": "560001"}
GPS_LAT, GPS_LNG = "12.9716", "77.5946"
#: What a store is given that an inspection brings along.
FOUND_STORE_NAME, FOUND_STORE_ADDRESS = "General Retail Store", "Market Area, Bengaluru"
CATEGORY, REMARKS = "Packaged Commodity", "AI-assisted field inspection screening."
STORE_COLUMNS = ["store_code", "store_name", "owner_name", "gstin", "fssai_license", "address", "city", "state", "pincode", "gps_lat", "gps_lng"]


def _code(prefix: str, of: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(of, 256), 1, 6)))


def inspection_number(image_id: Column) -> Column:
    return _code("INSP-2026-", image_id.cast("string"))


def _place(requests: DataFrame, lat: str, lng: str) -> list[Column]:
    given = lambda c, default: (F.coalesce(F.col(c), F.lit(default)) if c in requests.columns else F.lit(default)).cast("decimal(9,4)").alias(c)
    return [given("gps_lat", lat), given("gps_lng", lng)]


def stores(requests: DataFrame) -> DataFrame:
    """Store rows of requests (request_id and STORE_COLUMNS without the code, the licence as ``fssai``): nulls get the fixed defaults, if there are any."""
    key = F.col("request_id").cast("string")
    given = lambda c: F.coalesce(c, F.lit(STORE_DEFAULTS[c])).alias(c)
    return requests.select(
        "request_id", _code("STR-", key).alias("store_code"), given("store_name"), "owner_name", "gstin", F.col("fssai").alias("fssai_license"),
        given("address"), given("city"), given("state"), given("pincode"), *_place(requests, GPS_LAT, GPS_LNG))


def new_stores(requests: DataFrame, stores: DataFrame) -> DataFrame:
    """Store rows that requests (image_id, store_id, store_name, store_address, gps_lat, gps_lng) bring along: one for each whose store id is null or unknown."""
    unknown = requests.join(stores.select("store_id"), "store_id", "left_anti")
    none = F.lit(None).cast("string")
    fixed = [F.lit(STORE_DEFAULTS[c]).alias(c) for c in ("city", "state", "pincode")]
    return unknown.select(
        "image_id", _code("STR-", F.col("image_id").cast("string")).alias("store_code"), F.coalesce("store_name", F.lit(FOUND_STORE_NAME)).alias("store_name"),
        none.alias("owner_name"), none.alias("gstin"), none.alias("fssai_license"), F.coalesce("store_address", F.lit(FOUND_STORE_ADDRESS)).alias("address"),
        *fixed, *_place(requests, GPS_LAT, GPS_LNG))


def heads(requests: DataFrame, stores: DataFrame, *more: str) -> DataFrame:
    """What of requested inspections takes neither fields nor officers: image_id, inspection_number, store_code and category, and ``more`` of the requests' columns."""
    rows = requests.join(stores.select("store_id", "store_code"), "store_id", "left")
    return rows.select(
        "image_id", inspection_number(F.col("image_id")).alias("inspection_number"), F.coalesce("store_code", _code("STR-", F.col("image_id").cast("string"))).alias("store_code"),
        F.coalesce("category", F.lit(CATEGORY)).alias("category"), *more)


def inspections(requests: DataFrame, fields: DataFrame, stores: DataFrame, users: DataFrame) -> DataFrame:
    """Inspection rows of requests (image_id, officer_code, store_id, category): officer and store resolved, rules evaluated, fingerprint made.

    An unknown officer is the first inspector by id, or 1; an unknown or null store gets a new code; a null category is
    the general one; a request without fields lacks them all. ``breakdown`` has the five components.
    """
    first = users.where("role = 'INSPECTOR'").agg(F.min("user_id").alias("fallback_id"))
    evaluated = rules.evaluate(rules.wide(requests.select("image_id").join(fields, "image_id", "left")))
    rows = (heads(requests, stores, "officer_code").join(users.select("officer_code", "user_id"), "officer_code", "left").join(F.broadcast(first))  # one row
            .join(evaluated, "image_id"))
    tenths = F.col("score_tenths")
    score = F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return rows.withColumn("score", score).select(
        "image_id", "inspection_number", "store_code", F.coalesce("user_id", "fallback_id", F.lit(1)).cast("long").alias("officer_id"), "category",
        "compliance_status", "score_tenths", F.concat_ws("/", *rules.WEIGHTS).alias("breakdown"), F.col("violations_count").cast("long").alias("violations_count"),
        F.col("estimated_fee").cast("long").alias("fee"), F.lit("PENDING").alias("supervisor_status"), F.lit("SYNCED").alias("sync_status"),
        F.sha2(F.concat_ws("|", "inspection_number", "store_code", "score", F.col("violations_count").cast("string")), 256).alias("sha256_hash"))


def declarations(requests: DataFrame, fields: DataFrame) -> DataFrame:
    """Declaration rows of requested inspections: one for each field that was extracted. An inspection's number needs no evaluation."""
    rows = field_ops.declaration_rows(fields)
    return requests.select("image_id", inspection_number(F.col("image_id")).alias("inspection_number")).join(rows, "image_id").drop("image_id")


def violations(requests: DataFrame, fields: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Violation rows of requested inspections, open, as whole documents, with their ``image_id``; the rule table gives the rule's id alone.

    Images are told apart by their id: of many, some have the same inspection number, as it is a digest of six digits.
    """
    key = ["image_id", "inspection_number"]
    numbered = requests.select("image_id", inspection_number(F.col("image_id")).alias("inspection_number"))
    found = rules.documents(rules.wide(numbered.join(fields, "image_id", "left"), key), key)
    return found.join(rule_table.select("rule_code", "rule_id"), "rule_code", "left").select(
        *key, "place", "template", "rule_id", "rule_code", "category", "issue", "detected_value", "expected_requirement", "severity", "confidence",
        "legal_reference", "evidence_zone", F.col("amount").alias("compounding_amount"), F.lit("OPEN").alias("status"))


def audits(created: DataFrame, *more: str) -> DataFrame:
    """The audit row of each created inspection, with ``more`` of its columns; its number may be another one's as well."""
    details = F.to_json(F.struct(F.col("score_tenths").alias("score_tenths"), F.col("compliance_status").alias("status"), "violations_count"))
    return created.select("officer_id", F.lit("INSPECTION_CREATED").alias("action"), F.lit("INSPECTION").alias("target_type"), F.col("inspection_number").alias("target_id"), details.alias("details"), *more)


def verified(inspections: DataFrame, fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Created inspections after an officer's review: verified, with status, score and fee of the fields as edited, and their audit row's words.

    An inspection without declarations lacks all fields and stays.
    """
    again = inspections.select("image_id").join(field_ops.reevaluated(fields, edits), "image_id", "left")
    scored = rules.evaluate(rules.wide(again)).select("image_id", "compliance_status", "score_tenths", F.col("estimated_fee").cast("long").alias("fee"))
    edited = edits.groupBy("image_id").agg(F.sort_array(F.collect_set("field_name")).alias("edited_fields"))  # at most a field's name each
    details = F.to_json(F.struct(F.coalesce("edited_fields", F.array().cast("array<string>")).alias("edited_fields"), F.col("score_tenths").alias("new_score_tenths")))
    kept = inspections.select("image_id", "inspection_number", "officer_id")
    return kept.join(scored, "image_id").join(edited, "image_id", "left").select(
        "image_id", "inspection_number", "officer_id", F.lit(True).alias("officer_verified"), "compliance_status", "score_tenths", "fee",
        F.lit("INSPECTION_OFFICER_VERIFIED").alias("audit_action"), details.alias("audit_details"))
