"""Adapter view: offline submissions as JSON payloads, made from label fields; some can't be created."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.fields import fields
from shelfmark.sources.tables import parts


def requests(spark: SparkSession, d: str) -> DataFrame:
    """A request for each image, one in eleven without fields: some with unknown officers, without a store or with an unknown one (a negative id), or without a category."""
    k = F.col("p_partkey")
    return parts(spark, d).select(
        k.alias("image_id"), F.when(k % 6 == 0, "NOBODY").otherwise(F.concat(F.lit("LMO"), F.lpad((k % 20 + 1).cast("string"), 6, "0"))).alias("officer_code"),
        F.when(k % 5 != 0, F.when(k % 12 < 9, k % 12).otherwise(-(k % 12))).alias("store_id"), F.when(k % 3 == 0, "Food").alias("category"),
        F.when(k % 2 == 0, F.concat(F.lit("Corner Shop "), (k % 40).cast("string"))).alias("store_name"), F.when(k % 4 == 0, "Ring Road").alias("store_address"))


def requested_fields(spark: SparkSession, d: str) -> DataFrame:
    return fields(spark, d).where("image_id % 11 <> 0")


def submissions(spark: SparkSession, d: str) -> DataFrame:
    """offline_id, payload: the requests with their fields as JSON, and entries of other kinds among those (text, number, null, array)."""
    k, share = F.col("image_id"), (F.col("confidence") / 100).cast("decimal(5,2)")
    mrp = F.col("field_name") == "mrp"
    entry = F.struct("value", "raw_text", "status", share.alias("confidence"), F.when(F.col("field_name") == "net_quantity", "g").alias("unit"),
                     F.when(k % 2 == 0, F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), k % 100, F.lit(20).cast("long"))).alias("bounding_box"),
                     F.when(mrp, k % 9 == 0).alias("is_officer_edited"), F.when(mrp & (k % 9 == 0), "seen again").alias("officer_notes"))
    named = requested_fields(spark, d).select(k, F.concat(F.lit('"'), "field_name", F.lit('":'), F.to_json(entry)).alias("e"))
    per = named.groupBy("image_id").agg(F.array_join(F.sort_array(F.collect_list("e")), ",").alias("e"))
    rows = requests(spark, d).join(per, "image_id", "left")
    head = F.to_json(F.struct("store_id", F.col("officer_code").alias("officer_id"), "category", "store_name", "store_address"))
    more = '"note":"seen","count":3,"gone":null,"list":["a",{"value":"x"}]'
    whole = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"extracted_fields":{'), F.concat_ws(",", F.lit(more), "e"), F.lit("}}"))
    payload = (F.when(k % 29 == 0, "not json").when(k % 31 == 0, "[1, 2]").when(k % 37 == 0, '{"extracted_fields": "text"}')
               .when(k % 41 == 0, '{"extracted_fields": {"mrp": "50"}}').otherwise(whole))
    return rows.select(k.alias("offline_id"), payload.alias("payload"))


#: v_requests: the requests; v_sent: offline_id and why a submission can't be created.
VIEW_SQL = {
    "v_requests": """SELECT p_partkey AS image_id, CASE WHEN p_partkey % 6 = 0 THEN 'NOBODY' ELSE 'LMO' || lpad(CAST(p_partkey % 20 + 1 AS VARCHAR), 6, '0') END AS officer_code,
        CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 12 < 9 THEN p_partkey % 12 ELSE -(p_partkey % 12) END END AS store_id, CASE WHEN p_partkey % 3 = 0 THEN 'Food' END AS category,
        CASE WHEN p_partkey % 2 = 0 THEN 'Corner Shop ' || (p_partkey % 40) END AS store_name, CASE WHEN p_partkey % 4 = 0 THEN 'Ring Road' END AS store_address FROM part""",
    "v_sent": """SELECT p_partkey AS offline_id, CASE WHEN p_partkey % 29 = 0 THEN 'INVALID_JSON' WHEN p_partkey % 31 = 0 THEN 'NOT_AN_OBJECT'
        WHEN p_partkey % 37 = 0 THEN 'FIELDS_NOT_AN_OBJECT' WHEN p_partkey % 41 = 0 THEN 'FIELD_NOT_AN_OBJECT' END AS error FROM part""",
}
