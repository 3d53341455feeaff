"""Plans that have to hold on large tables: what is made of the parts is dealt over tasks and never gathered on the driver."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.ledger import Ledger, numbered
from shelfmark.plans import catalog
from shelfmark.sources import labels, submissions, tables
from shelfmark.sources.fields import fields

SF = "/root/testdata/sf0.001"


def test_parts_are_dealt_into_bounded_partitions(spark, monkeypatch):
    monkeypatch.setattr(tables, "PARTS_A_TASK", 20)
    for made in (labels.label_lines(spark, SF), labels.ocr_boxes(spark, SF), fields(spark, SF), submissions.requests(spark, SF)):
        images = made.select("image_id").distinct().rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(images) >= 180 and len(images) >= 10 and max(images) <= 60


@pytest.mark.parametrize("name", ["q_analyze_evidence", "q_ocr_fusion", "q_payload_declarations", "q_spatial_relation", "q_text_similarity"])
def test_rows_of_parts_are_not_broadcast(spark, name):
    """These read the parts alone, and so small here that a side that may be broadcast is."""
    assert "BroadcastExchange" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q_create_inspection", "q_created_audits", "q_inspection_documents", "q_inspection_detail", "q_officer_resolution", "q_new_stores"])
def test_stores_and_users_are_not_broadcast(spark, name):
    """What is broadcast of the registry's tables is one row, or the nations; these files would be small enough."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and ("store_id" in line or "officer" in line)]
    assert joins and all("strategy=merge" in line for line in joins)


def test_ledger_tables_are_not_broadcast(spark, tmp_path):
    """Thousands of equal rows make a file of some kilobytes."""
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    rows = spark.range(1000).select("id", F.lit("the same").alias("said"))
    assert ledger.publish("1", {"t": rows})
    made = numbered(rows, ["id"], "n", f"file://{tmp_path}/n")
    for right in (ledger.read("t"), made):
        plan = rows.withColumnRenamed("said", "x").join(right, "id", "left")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [id" in plan


def test_one_inspection_cuts_all_sides_down_first(spark):
    """Declarations, stores and users: else all stores and users are sorted, or broadcast, for one row."""
    plan = catalog.QUERIES["q_inspection_by_id"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 3


def test_arrays_of_inspections_are_moved_once(spark):
    """The declarations are joined last, the violations before them, after stores and officers."""
    plan = catalog.QUERIES["q_inspection_documents"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [next(k for k in ("image_id", "inspection_id", "store_id", "officer_id") if k in line) for line in plan.splitlines() if "Join LeftOuter" in line]
    assert joins == ["image_id", "inspection_id", "officer_id", "store_id"]


def test_dates_are_looked_for_once(spark):
    from pyspark.sql import functions as F

    from shelfmark.functions import scalars

    dates = spark.range(1).select(scalars.parse_date(F.col("id").cast("string")).alias("d"))
    plan = dates._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("regexp_extract(") <= 7


@pytest.mark.parametrize("name", ["q_report_rows", "q_external_merge", "q_verified_declarations", "q_verify_reeval", "q_reports_regenerated", "q_verify_inspection"])
def test_fields_stay_with_their_image(spark, name):
    """Dealt by image and field they would be in as many partitions as the session has, at any size of the table."""
    query = catalog.QUERIES["q_report_documents" if name == "q_reports_regenerated" else name]
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and not any("field_name" in line for line in dealt)


def test_findings_are_taken_as_a_join_takes_them(spark):
    from shelfmark.operators import fields as field_ops

    rows = spark.createDataFrame([(1, "mrp", "5"), (1, "batch", "b"), (1, None, "n"), (2, "mrp", None), (None, "mrp", "x")], "image_id long, field_name string, value string")
    found = spark.createDataFrame([(1, "mrp", "6"), (1, "mrp", None), (1, None, "7"), (None, "mrp", "8"), (3, "mrp", "9")], "image_id long, field_name string, edit string")
    want = rows.join(found, ["image_id", "field_name"], "left").select(*rows.columns, "edit")
    assert sorted(map(str, field_ops._with_found(rows, found).collect())) == sorted(map(str, want.collect()))


def test_reports_gather_fields_once(spark):
    """Fields and what was verified of them are each made from the parts once, and no rules are evaluated beside the report's."""
    plan = catalog.QUERIES["q_report_documents"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(array(") == 2 and "c_custkey" not in plan


@pytest.mark.parametrize("name", ["q_create_inspection", "q_created_audits"])
def test_what_is_broadcast_is_not_made_of_parts(spark, name):
    """Exploded rows, which Spark takes for as few as the parts were, failed on their way to the driver."""
    lines = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    gathered, at = [], None
    for line in lines:
        if at is not None and depth(line) <= at:
            at = None
        if at is None and "BroadcastExchange" in line:
            at = depth(line)
        if at is not None:
            gathered.append(line)
    assert gathered and not any("Generate" in line or "p_partkey" in line for line in gathered)
