"""Submissions as JSON documents whose fields may be of any kind: read as VARIANT, taken apart, and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import rules
from shelfmark.operators.fields import DEFAULT_CONFIDENCE, READABLE


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, VOID, STRING, ... of a variant; null of null."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def _text(value: Column, path: str) -> Column:
    """What is at ``path`` as text, scalars as they are and objects and arrays as JSON; null where nothing or null is."""
    at = F.try_variant_get(value, path, "variant")
    return F.coalesce(F.try_variant_get(at, "$", "string"), F.when(_kind(at) != "VOID", F.to_json(at)))


def entries(submissions: DataFrame, key: str = "offline_id", payload: str = "payload") -> DataFrame:
    """One row an entry of ``extracted_fields``: the key, field_name, entry (VARIANT) and kind. Payloads without such an object give none."""
    doc = submissions.select(key, F.try_variant_get(F.try_parse_json(payload), "$.extracted_fields", "variant").alias("_fields"))
    doc = doc.where(_kind(F.col("_fields")) == "OBJECT")  # an array would be taken apart as well
    taken = doc.lateralJoin(doc.sparkSession.tvf.variant_explode(F.col("_fields").outer()))
    return taken.select(key, F.col("key").alias("field_name"), F.col("value").alias("entry"), _kind(F.col("value")).alias("kind"))


def declared(entries: DataFrame, key: str = "offline_id") -> DataFrame:
    """Declaration rows of the entries that are objects, any others are skipped; confidence in hundredths.

    Present means that the status doesn't say MISSING; a confidence that isn't there is stored as 90 and counts as 0 for
    readability; the normalized value is the value where it isn't given.
    """
    e = F.col("entry")
    confidence = F.round(F.try_variant_get(e, "$.confidence", "decimal(18,6)") * 100).cast("long")
    value, normalized = _text(e, "$.value"), F.nullif(_text(e, "$.normalized_value"), F.lit(""))
    return entries.where("kind = 'OBJECT'").select(
        key, "field_name", value.alias("detected_value"), F.coalesce(normalized, value).alias("normalized_value"), _text(e, "$.unit").alias("unit"),
        (F.coalesce(_text(e, "$.status"), F.lit("")) != "MISSING").alias("is_present"), F.coalesce(confidence, F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        F.when(F.coalesce(confidence, F.lit(0)) > READABLE, "PASS").otherwise("FLAGGED").alias("readability_status"), _text(e, "$.bounding_box").alias("raw_bounding_box"),
        F.coalesce(F.try_variant_get(e, "$.is_officer_edited", "boolean"), F.lit(False)).alias("is_officer_edited"), _text(e, "$.officer_notes").alias("officer_notes"),
        _text(e, "$.raw_text").alias("raw_text"), _text(e, "$.status").alias("status"))


def error(doc: Column) -> Column:
    """Why a payload, parsed, can't be created, or null: it must be a JSON object, its fields (if it has any) an object, and so each of those that the rules read."""
    fields = F.try_variant_get(doc, "$.extracted_fields", "variant")
    odd = F.lit(False)
    for name in rules.FIELDS:
        odd = odd | (F.coalesce(_kind(F.try_variant_get(fields, f"$.{name}", "variant")), F.lit("OBJECT")) != "OBJECT")
    return (F.when(doc.isNull(), "INVALID_JSON").when(_kind(doc) != "OBJECT", "NOT_AN_OBJECT")
            .when(F.coalesce(_kind(fields), F.lit("OBJECT")) != "OBJECT", "FIELDS_NOT_AN_OBJECT").when(odd, "FIELD_NOT_AN_OBJECT"))


def checked(submissions: DataFrame, key: str = "offline_id", payload: str = "payload") -> DataFrame:
    """Each submission with its ``error``, and what it asks for: officer_code, store_id, store_name, store_address, category, remarks.

    What is merely odd, such as a price that is no number, or missing, such as the store, is created and is the rules' matter.
    A payload is parsed once for all that is read of it, as a column of its own.
    """
    doc = F.col("_doc")
    asked = {"officer_code": "$.officer_id", "store_name": "$.store_name", "store_address": "$.store_address", "category": "$.category", "remarks": "$.remarks"}
    return submissions.select(key, payload, F.try_parse_json(payload).alias("_doc")).select(key, payload, error(doc).alias("error"), F.try_variant_get(doc, "$.store_id", "long").alias("store_id"), *(_text(doc, path).alias(c) for c, path in asked.items()))


def results(checked: DataFrame, created: DataFrame, key: str = "offline_id") -> DataFrame:
    """What the sender is told of each submission: its own id, the inspection's number if it was created, or the error."""
    numbers = created.select(F.col("image_id").alias(key), "inspection_number")
    return checked.join(numbers, key, "left").select(
        key, F.when(F.col("error").isNull(), F.col("inspection_number")).alias("server_inspection_number"), "error", F.when(F.col("error").isNull(), "SYNCED").otherwise("FAILED").alias("status"))
