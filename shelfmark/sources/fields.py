"""Adapter view: extracted fields in long form, from label lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources import labels

KINDS = {"product": "product_name", "manufacturer": "manufacturer_name", "address": "manufacturer_address", "quantity": "net_quantity", "mrp": "mrp",
         "mfg_date": "manufacturing_date", "care": "consumer_care", "origin": "country_of_origin", "batch": "batch_number", "expiry": "expiry_date"}


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, field_name, value, raw_text, status, confidence (hundredths; null at times). A few rows have no status."""
    key = F.col("image_id") + F.col("line")
    names = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    value = F.when(F.col("value") == "", F.col("label")).otherwise(F.col("value"))
    lines = labels.label_lines(spark, sf_dir).where(F.col("kind") != "other")
    return lines.select("image_id", names[F.col("kind")].alias("field_name"), value.alias("value"), F.col("text").alias("raw_text"),
                        F.when(key % 23 == 0, F.lit(None)).when(key % 19 == 0, "MISSING").when(key % 7 == 0, "LOW_CONFIDENCE").otherwise("CONFIRMED").alias("status"),
                        F.when(key % 5 != 0, 40 + key * 13 % 60).alias("confidence"))


VIEW_SQL = {"v_fields": "SELECT image_id, CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + """ END AS field_name, CASE WHEN value = '' THEN label ELSE value END AS value,
    text AS raw_text, CASE WHEN (image_id + line) % 23 = 0 THEN NULL WHEN (image_id + line) % 19 = 0 THEN 'MISSING' WHEN (image_id + line) % 7 = 0 THEN 'LOW_CONFIDENCE' ELSE 'CONFIRMED' END AS status,
    CASE WHEN (image_id + line) % 5 <> 0 THEN 40 + (image_id + line) * 13 % 60 END AS confidence FROM v_lines WHERE kind <> 'other'"""}
