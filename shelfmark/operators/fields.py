"""Operators over extracted fields in long form (image_id, field_name, value, raw_text, status, confidence in hundredths)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import scalars as S

DEFAULT_CONFIDENCE = 90  # stored where none was given
READABLE = 60  # confidence above this passes; none counts as 0


def edits(fields: DataFrame) -> DataFrame:
    """Officers' edits for the adapter's fields: image_id, field_name, edit. Some repeat the value that was detected."""
    k, f = F.col("image_id"), F.col("field_name")
    edit = F.when((f == "mrp") & (k % 4 == 0), "99.00").when((f == "net_quantity") & (k % 6 == 0), "250 g").when((f == "country_of_origin") & (k % 9 == 0), F.col("value"))
    return fields.select("image_id", "field_name", edit.alias("edit")).where("edit IS NOT NULL")


def _with_found(fields: DataFrame, found: DataFrame) -> DataFrame:
    """``fields`` with the other columns of ``found``, a left join by image_id and field_name that leaves fields where they are.

    Fields are dealt by image, and Spark would deal them anew for a join with two keys, into as many partitions as the
    session has, however many rows there are. So what was found is gathered by image (a few rows at most), and each field
    takes its own from there.
    """
    more = [c for c in found.columns if c not in ("image_id", "field_name")]
    per = found.groupBy("image_id").agg(F.collect_list(F.struct("field_name", *more)).alias("_found"))
    own = F.filter("_found", lambda x: x["field_name"] == F.col("field_name"))
    rows = fields.join(per, "image_id", "left").select(*fields.columns, F.explode_outer(own).alias("_own"))
    return rows.select(*fields.columns, *(F.col("_own")[c].alias(c) for c in more))


def verified_declarations(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Declarations after an officer's review: an edit that says something else replaces the value, is marked, and is sure (100)."""
    changed = F.col("edit").isNotNull() & ~F.col("edit").eqNullSafe(F.col("value"))
    return _with_found(fields, edits).select(
        "image_id", "field_name", F.when(changed, F.col("edit")).otherwise(F.col("value")).alias("detected_value"), changed.alias("is_officer_edited"),
        F.when(changed, F.lit(100)).otherwise(F.col("confidence")).cast("long").alias("confidence"))


def reevaluated(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Fields as they are evaluated again after edits: any value is confirmed, and is the raw text as well, so a bare number has no unit and no tax phrase."""
    value = F.col("detected_value")
    return verified_declarations(fields, edits).select(
        "image_id", "field_name", value.alias("value"), value.alias("raw_text"), F.when(F.coalesce(value, F.lit("")) != "", "CONFIRMED").otherwise("MISSING").alias("status"))


def summary(fields: DataFrame) -> DataFrame:
    status = F.col("status")
    per = fields.groupBy("image_id").agg(
        F.count_if(status == "CONFIRMED").alias("confirmed"), F.count_if(status == "LOW_CONFIDENCE").alias("low_confidence"),
        F.count_if((status == "MISSING") | status.isNull()).alias("missing"), F.sum("confidence").cast("long").alias("confidence_sum"), F.count("confidence").alias("confidence_count"),
        F.count(F.lit(1)).alias("n"))
    # a field without a confidence counts as 0
    return per.withColumn("overall_milli", S.mean_milli(F.coalesce("confidence_sum", F.lit(0)), F.col("n"))).drop("n")


def declaration_rows(fields: DataFrame) -> DataFrame:
    return fields.select(
        "image_id", "field_name", F.col("value").alias("detected_value"), (F.coalesce("status", F.lit("")) != "MISSING").alias("is_present"),
        F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)).cast("long").alias("stored_confidence"),
        F.when(F.coalesce("confidence", F.lit(0)) > READABLE, "PASS").otherwise("FLAGGED").alias("readability"))


def sample_verification(fields: DataFrame) -> DataFrame:
    """An external check's findings on prices and quantities: image_id, field_name, seen, seen_raw, seen_status, seen_notes (null: nothing to say)."""
    k = F.col("image_id")
    return fields.where(F.col("field_name").isin("mrp", "net_quantity")).select(
        "image_id", "field_name", F.when(k % 6 == 0, F.upper("value")).alias("seen"), F.when(k % 4 == 0, F.concat(F.lit("read: "), "value")).alias("seen_raw"),
        F.when(k % 5 == 0, "CONFIRMED").when(k % 5 == 1, "CONFLICTING").when(k % 5 == 2, "").alias("seen_status"), F.when(k % 7 == 0, "blurred").alias("seen_notes"))


def external_merge(fields: DataFrame, verification: DataFrame) -> DataFrame:
    """Fields with an external check's findings put in, where it has any: value, raw text, status and notes (empty texts are none).

    A field that was checked is at least 95 sure, and its source says so.
    """
    checked = F.col("checked").isNotNull()
    found = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))
    return _with_found(fields, verification.withColumn("checked", F.lit(True))).select(
        "image_id", "field_name", F.coalesce("seen", "value").alias("value"), found("seen_raw", "raw_text").alias("raw_text"),
        F.when(checked, F.greatest(F.coalesce("confidence", F.lit(0)), F.lit(95))).otherwise(F.col("confidence")).alias("confidence"),
        found("seen_status", "status").alias("status"), F.nullif(F.col("seen_notes"), F.lit("")).alias("visual_notes"),
        F.when(checked, "EnsembleOCR+External").otherwise("EnsembleOCR").alias("source_model"))


def report_rows(fields: DataFrame, evaluated: DataFrame) -> DataFrame:
    """A report row an inspection: fields by name with value (45 characters at most), source (20) and confidence in percent, the score, the fee with thousands marked."""
    share = F.concat(F.format_number(F.coalesce("confidence", F.lit(0)).cast("decimal(5,1)"), 1), F.lit("%"))
    line = F.concat(F.col("field_name"), F.lit("="), F.substring(F.coalesce("value", F.lit("NOT DETECTED")), 1, 45), F.lit(" ["), F.substring("source_model", 1, 20), F.lit("] "), share)
    lines = fields.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("field_name", line.alias("t")))), lambda x: x["t"]), "; ").alias("lines"))
    return lines.join(evaluated, "image_id").select("image_id", "lines", "score_tenths", F.format_number("estimated_fee", 0).alias("fee_text"))


def prompt_lines(boxes: DataFrame, n: int = 40) -> DataFrame:
    """The first ``n`` lines of each image, in the order of its list, as one text: what a checking model is shown."""
    per = boxes.groupBy("image_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("idx", "text"))), 1, n).alias("x"))
    return per.select("image_id", F.array_join(F.transform("x", lambda b: b["text"]), "\n").alias("lines"), F.size("x").cast("long").alias("n_lines"))


def result_documents(fields: DataFrame, evaluated: DataFrame) -> DataFrame:
    """One JSON result an image: its fields, the counts over them, score, status and fee."""
    field = F.struct("field_name", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("status", F.lit("MISSING")).alias("status"), F.coalesce("confidence", F.lit(0)).cast("long").alias("confidence"))
    per = fields.groupBy("image_id").agg(F.sort_array(F.collect_list(field)).alias("extracted_fields"))
    count = lambda status: F.size(F.filter("extracted_fields", lambda x: x["status"] == status))
    audit = F.struct(F.size("extracted_fields").alias("total_fields"), count("CONFIRMED").alias("confirmed_count"), count("LOW_CONFIDENCE").alias("low_confidence_count"), count("MISSING").alias("missing_count"))
    said = F.struct("extracted_fields", audit.alias("audit_summary"), "score_tenths", "compliance_status", F.col("estimated_fee").cast("long").alias("estimated_fee"))
    return per.join(evaluated, "image_id").select("image_id", F.to_json(said).alias("result"))
