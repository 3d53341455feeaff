"""Inspection reports: what each one says, and a sink of JSON files in which only what is missing is written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import rules

# The declarations that a report shows, with what they are called, and what it says of prosecution.
SHOWN = [
    ("product_name", "Product Common Name (6(1)(a))"), ("manufacturer_name", "Manufacturer / Packer (6(1)(b))"), ("manufacturer_address", "Complete Address (6(1)(b))"),
    ("net_quantity", "Net Quantity (6(1)(c) & R12)"), ("mrp", "MRP (Incl. of all taxes) (6(1)(e))"), ("manufacturing_date", "Mfg / Pkg Date (6(1)(d))"),
    ("consumer_care", "Consumer Care Details (6(1)(n))"), ("country_of_origin", "Country of Origin (6(1)(f))"), ("batch_number", "Batch / Lot No."),
]
PROSECUTE, COMPOUND = "YES — Refer to Judicial Magistrate First Class", "Eligible for Compounding under Section 48"
NONE_FOUND = "NOT DETECTED"
BUCKETS = 64  # folders of a sink
PER_FILE = 10_000  # reports in a file, at most


def _row(name: str, label: str) -> Column:
    f = F.col("fields")[name]
    value = F.coalesce(F.nullif(f["value"], F.lit("")), F.lit(NONE_FOUND))
    return F.struct(
        F.lit(label).alias("declaration"), F.substring(value, 1, 45).alias("value"), F.substring(F.coalesce(f["source_model"], F.lit("Ensemble")), 1, 20).alias("source"),
        F.concat(F.format_number(F.coalesce(f["confidence"], F.lit(0)).cast("decimal(5,1)"), 1), F.lit("%")).alias("confidence"),
        F.when(f["status"] == "CONFIRMED", "PASS").otherwise("FLAGGED / MISSING").alias("compliance"))


def documents(inspections: DataFrame, fields: DataFrame) -> DataFrame:
    """One report a row of ``inspections`` (image_id, inspection_number, store_code, category): inspection_number, product_name, category,
    score, status, ``declarations`` (a row for each of SHOWN), ``violations``, fee and prosecution as said, and the report's digest.

    ``fields``: image_id, field_name (once an image), value, raw_text, status, confidence in hundredths, source_model. An
    inspection without fields has a report all the same. Of the digest's five parts the last is the whole fee. Fields are
    gathered once, to a row an image, and all that is said of them is made from that row.
    """
    names = [name for name, _ in SHOWN]  # the rules' fields are among them
    entry = F.struct("value", "raw_text", "status", "confidence", "source_model")
    named = fields.groupBy("image_id").pivot("field_name", names).agg(F.first(entry)).hint("merge")
    wide = rules.spread(inspections.join(named, "image_id", "left"))
    said = lambda v, i: F.struct(
        i.cast("long").alias("place"), v["rule_code"].alias("rule_code"), v["legal_reference"].alias("legal_reference"), v["issue"].alias("issue"), v["severity"].alias("severity"),
        F.concat(F.lit("₹"), F.format_number(v["amount"], 0)).alias("fee"))
    rows = rules.evaluate(wide.withColumns({"fields": F.struct(*names), "violations": F.transform(rules.found(), said)}), ["inspection_number", "store_code", "category", "fields", "violations"])
    score = F.concat((F.col("score_tenths") / 10).cast("long").cast("string"), F.lit("."), (F.col("score_tenths") % 10).cast("string"))
    fee = F.col("estimated_fee").cast("long")
    return rows.select(
        "inspection_number", F.coalesce(F.nullif(F.col("fields")["product_name"]["value"], F.lit("")), F.lit("Packaged Commodity")).alias("product_name"), "category",
        score.alias("compliance_score"), "compliance_status", F.array(*(_row(*x) for x in SHOWN)).alias("declarations"), "violations",
        F.concat(F.lit("₹"), F.format_number(fee, 0)).alias("compounding_fee"), F.when(F.col("prosecution_recommended"), PROSECUTE).otherwise(COMPOUND).alias("prosecution"),
        F.sha2(F.concat_ws("|", "inspection_number", "store_code", score, F.col("violations_count").cast("string"), F.concat(fee.cast("string"), F.lit(".0"))), 256).alias("digest"))


def written(documents: DataFrame, path: str) -> DataFrame:
    """The sink's reports: documents as JSON below ``path``, those that are not there yet written first, and the sink read back.

    What is there is read from the files themselves, its numbers alone, so reports that were deleted, files or whole
    folders, are made again and no others. Reports are dealt into BUCKETS folders by their number, PER_FILE to a file.
    """
    spark = documents.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    missing = documents
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        missing = documents.join(spark.read.schema("inspection_number string").json(path).select("inspection_number"), "inspection_number", "left_anti")
    dealt = missing.withColumn("bucket", F.pmod(F.crc32("inspection_number"), F.lit(BUCKETS)).cast("int"))
    dealt.repartition(BUCKETS, "bucket").write.mode("append").option("maxRecordsPerFile", PER_FILE).partitionBy("bucket").json(path)
    return spark.read.schema(documents.schema).json(path).select(documents.columns)
