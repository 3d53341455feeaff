"""Batches of several tables, versions and the stream of submissions, through failures and repeats; and the fixed values of reviews."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import creation, payloads, rules, versions, workflow
from shelfmark.operators import fields as field_ops
from shelfmark.operators.ledger import Ledger, numbered
from shelfmark.operators.registration import register
from shelfmark.sources import dimensions
from shelfmark.streaming import sync

STORES = "store_id long, store_code string, store_name string"


def registry(spark):
    stores = spark.createDataFrame([(1, "STR-1", "One"), (2, "STR-2", "Two")], STORES)
    users = spark.createDataFrame([(7, "LMO7", "Seven", "INSPECTOR")], "user_id long, officer_code string, full_name string, role string")
    return stores, users, dimensions.rules(spark)


def requests(spark, ids):
    rows = [(i, "LMO7" if i % 2 else "X", 1 if i % 3 == 0 else 99 if i % 3 == 1 else None, f"shop {i}" if i % 2 else None, None, None, None) for i in ids]
    return spark.createDataFrame(rows, "image_id long, officer_code string, store_id long, store_name string, store_address string, category string, remarks string")


def declared(spark, ids):
    rows = [(i, f, "x", "x", None, True, 90, "PASS", None, False, None, "x", "CONFIRMED") for i in ids for f in rules.FIELDS[: i % 9]]
    return spark.createDataFrame(rows, "image_id long, field_name string, detected_value string, normalized_value string, unit string, is_present boolean, confidence long, readability_status string, "
                                       "raw_bounding_box string, is_officer_edited boolean, officer_notes string, raw_text string, status string")


def whole(ledger):
    """All tables of the registry, with what must hold of them checked."""
    tables = {t: ledger.read(t).collect() for t in ("stores", "inspections", "declarations", "violations", "audits")}
    parents = {r["inspection_id"] for r in tables["inspections"]}
    for t, key in (("inspections", "inspection_id"), ("declarations", "declaration_id"), ("violations", "violation_id"), ("audits", "audit_id")):
        assert sorted(r[key] for r in tables[t]) == list(range(1, len(tables[t]) + 1))
        assert {r["inspection_id"] for r in tables[t]} <= parents
    assert sorted(r["store_id"] for r in tables["stores"]) == list(range(3, 3 + len(tables["stores"])))
    assert {r["store_id"] for r in tables["inspections"]} <= {1, 2} | {r["store_id"] for r in tables["stores"]}
    return {t: sorted(map(str, rows)) for t, rows in tables.items()}


def test_batches_are_seen_whole_or_not_at_all(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/r")
    first, second = list(range(20)), list(range(20, 33))
    assert register(ledger, "1", requests(spark, first), declared(spark, first), *registry(spark))
    before = whole(ledger)
    assert not register(ledger, "1", requests(spark, second), declared(spark, second), *registry(spark)) and whole(ledger) == before
    broken = spark.range(1).select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        register(ledger, "2", requests(spark, second), declared(spark, second), *registry(spark), {"results": broken})
    assert whole(ledger) == before  # the other tables' rows of the batch are on disk, and not there
    assert register(ledger, "2", requests(spark, second), declared(spark, second), *registry(spark))
    after = whole(ledger)
    assert len(after["inspections"]) == 33 and all(set(before[t]) <= set(after[t]) for t in before)
    again = Ledger(spark, f"file://{tmp_path}/s")
    for batch, ids in (("1", first), ("2", second)):
        register(again, batch, requests(spark, ids), declared(spark, ids), *registry(spark))
    assert whole(again) == after


def test_numbers_have_no_gaps(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    got = numbered(df, ["k"], "n", f"file://{tmp_path}/n", 5).orderBy("n").collect()
    assert [tuple(r) for r in got] == [(i, i + 5) for i in range(1000)]
    assert numbered(df.limit(0), ["k"], "n", f"file://{tmp_path}/m").count() == 0


def test_versions_and_compaction(spark, tmp_path):
    at = lambda day: datetime(2026, 1, day)
    rows = [(1, at(1), 1, "a", 10), (1, at(3), 2, None, 20), (1, at(3), 3, "b", None), (2, at(2), 4, "c", None), (1, at(9), 5, None, 30), (None, at(1), 6, "n", 1)]
    log = spark.createDataFrame(rows, "k long, changed_at timestamp_ntz, change_id long, x string, y long")
    ledger = Ledger(spark, f"file://{tmp_path}/v")
    versions.append(ledger, "1", "log", log.where("change_id < 4"))
    versions.append(ledger, "2", "log", log.where("change_id >= 4"))
    state = lambda day: sorted(((r["k"], r["x"], r["y"], r["change_id"]) for r in versions.as_of(ledger.read("log"), "k", at(day) if day else None).collect()), key=str)
    want = {1: [(1, "a", 10, 1), (None, "n", 1, 6)], 3: [(1, "b", 20, 3), (2, "c", None, 4), (None, "n", 1, 6)], None: [(1, "b", 30, 5), (2, "c", None, 4), (None, "n", 1, 6)]}
    assert {d: state(d) for d in want} == want
    assert versions.compact(ledger, "3", "log", "k", at(4)) and ledger.live("log") == ["3"] and ledger.read("log").count() == 4
    assert {d: state(d) for d in (4, 9, None)} == {4: want[3], 9: want[None], None: want[None]}


def write(spark, path, name, rows):
    spark.createDataFrame([(i, p, datetime.fromisoformat(s)) for i, p, s in rows], "offline_id long, payload string, sent_at timestamp").coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def test_stream_creates_each_submission_once(spark, tmp_path):
    base, ledger = f"file://{tmp_path}", Ledger(spark, f"file://{tmp_path}/ledger")
    good = json.dumps({"store_id": 1, "officer_id": "LMO7", "extracted_fields": {"mrp": {"value": "a price that is odd", "status": "CONFIRMED"}, "note": 3}})
    fails = {"left": 0}

    def before(batch_id):
        if fails["left"]:
            fails["left"] -= 1
            # the tables of the batch are half written when the job dies
            spark.range(3).write.mode("overwrite").parquet(f"{ledger.root}/inspections/batch=sync-{batch_id:012d}")
            raise RuntimeError("lost")

    def run():
        source = spark.readStream.schema("offline_id long, payload string, sent_at timestamp").parquet(f"{base}/in/*")
        query = sync.start(sync.answered(source), ledger, f"{base}/cp", *registry(spark), before)
        try:
            assert query.awaitTermination(240)
        finally:
            query.stop()

    write(spark, f"{base}/in", "a", [(1, good, "2026-01-01 10:00:00"), (1, "not json", "2026-01-01 11:00:00"), (2, "not json", "2026-01-01 10:00:00"), (3, "[1]", "2026-01-01 10:00:00"),
                                     (4, '{"extracted_fields": {"mrp": "5"}}', "2026-01-01 10:00:00"), (5, "{}", "2026-01-01 10:00:00")])
    run()
    write(spark, f"{base}/in", "b", [(1, good, "2026-02-15 10:00:00"), (6, good, "2026-02-15 10:00:00"), (3, good, "2026-02-15 10:00:00"), (None, good, "2026-02-15 10:00:00")])
    fails["left"] = 1
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    results = sorted(((r["offline_id"], r["is_repeat"], r["status"], r["error"]) for r in ledger.read("sync_results").where("offline_id IS NOT NULL").collect()), key=str)
    assert ledger.read("quarantine").where("offline_id IS NULL AND error = 'NO_ID'").count() == 1
    assert results == [(1, False, "FAILED", "INVALID_JSON"), (1, False, "SYNCED", None), (1, True, "SYNCED", None), (2, False, "FAILED", "INVALID_JSON"), (3, False, "FAILED", "NOT_AN_OBJECT"), (3, False, "SYNCED", None),
                       (4, False, "FAILED", "FIELD_NOT_AN_OBJECT"), (5, False, "SYNCED", None), (6, False, "SYNCED", None)]
    numbers = {(r["offline_id"], r["server_inspection_number"]) for r in ledger.read("sync_results").where("status = 'SYNCED'").collect()}
    assert len(numbers) == 4  # a repeat six weeks later is told the first number
    assert {n for _, n in numbers} == {r["inspection_number"] for r in ledger.read("inspections").collect()}
    assert sorted(r["offline_id"] for r in ledger.read("quarantine").where("offline_id IS NOT NULL").collect()) == [1, 2, 3, 4]
    tables = whole(ledger)
    assert len(tables["inspections"]) == 4 and len(tables["declarations"]) == 3


def test_supervisors_actions(spark):
    """The words that supervisors use, and what each does to status and fee."""
    cases = {"ISSUE_COMPOUNDING_NOTICE": ("COMPOUNDED", 2500), "REFER_FOR_PROSECUTION": ("REFERRED_FOR_PROSECUTION", 900), "APPROVE_COMPLIANT": ("APPROVED", 900), "COMPOUND": ("APPROVED", 900), None: ("APPROVED", 900)}
    i = spark.createDataFrame([(n, f"INSP-{n}", "PENDING", 900) for n in range(len(cases) + 1)], "inspection_id long, inspection_number string, supervisor_status string, fee int")
    a = spark.createDataFrame([(n, action, None, 2500) for n, action in enumerate(cases)], "inspection_id long, action string, notes string, fee int")
    got = {r["inspection_id"]: (r["supervisor_status"], r["fee"]) for r in workflow.adjudicate(i, a).collect()}
    assert got == dict(enumerate(cases.values())) | {len(cases): ("PENDING", 900)}
    audit = {r["target_id"]: (r["officer_name"], r["action"], r["target_type"], json.loads(r["details"])) for r in workflow.adjudication_audits(i, a).collect()}
    assert audit["INSP-0"] == ("Supervisor", "SUPERVISOR_ISSUE_COMPOUNDING_NOTICE", "INSPECTION", {"action": "ISSUE_COMPOUNDING_NOTICE", "notes": "", "compounding_fee": "2500"})
    assert audit["INSP-1"][3]["compounding_fee"] == "900" and audit["INSP-4"][1] == "SUPERVISOR_APPROVE_COMPLIANT" and len(audit) == 5


def test_tasks_need_an_officer_and_a_store(spark):
    stores, users, _ = registry(spark)
    tasks = spark.createDataFrame([(1, 1, 7, None, None), (2, 1, 8, "Food", "x"), (3, 9, 7, "Food", "x"), (4, None, None, None, None)], "task_id long, store_id long, officer_id long, category string, notes string")
    got = {r["task_id"]: r for r in workflow.assign(tasks, users, stores).collect()}
    assert [got[k]["error"] for k in (1, 2, 3, 4)] == [None, "Assigned officer not found.", "Store premises not found.", "Assigned officer not found."]
    assert (got[1]["category"], got[1]["remarks"], got[1]["compliance_status"], got[1]["supervisor_status"], got[1]["audit_details"]) == (
        "Packaged Food / Retail", "Routine Market Surveillance Audit", "PENDING_AUDIT", "ASSIGNED", '{"assigned_to":"Seven","store":"One"}')
    assert got[2]["inspection_number"] is None


def test_violation_documents_by_hand(spark):
    rows = [(1, "net_quantity", "250", " 250 GMS ", "CONFIRMED"), (1, "consumer_care", "c", "care@x.example", "CONFIRMED"), (1, "manufacturer_address", "short", "short", "CONFIRMED"), (1, "mrp", "5", "Rs 5", "CONFIRMED")]
    fields = spark.createDataFrame(rows, "image_id long, field_name string, value string, raw_text string, status string")
    got = {r["template"]: r for r in rules.documents(rules.wide(fields)).collect()}
    assert list(got) == ["R1", "R2", "R3b", "R4b", "R5b", "R6", "R7b", "R8"]
    assert (got["R1"]["category"], got["R1"]["detected_value"], got["R1"]["legal_reference"]) == ("Product Identity", "Not Detected", "Rule 6(1)(a), Legal Metrology (PC) Rules, 2011")
    assert (got["R4b"]["issue"], got["R4b"]["detected_value"], got["R4b"]["legal_reference"]) == (
        "Forbidden non-standard unit abbreviation 'gms' detected in net quantity.", "250 GMS", "Rule 12 & Schedule III, Legal Metrology (PC) Rules, 2011")
    assert got["R7b"]["issue"] == "Consumer care grievance cell incomplete: missing phone number." and got["R3b"]["detected_value"] == "short"
    assert (got["R5b"]["confidence"], got["R5b"]["evidence_zone"], got["R5b"]["amount"]) == (93, "MRP Zone", 5000)


def test_verified_without_declarations_and_readability(spark):
    i = spark.createDataFrame([(1, "N1", 7), (2, "N2", 7)], "image_id long, inspection_number string, officer_id long")
    f = spark.createDataFrame([(1, "mrp", "5", "5", "CONFIRMED", 70)], "image_id long, field_name string, value string, raw_text string, status string, confidence int")
    e = spark.createDataFrame([(1, "mrp", "6")], "image_id long, field_name string, edit string")
    got = {r["image_id"]: (r["score_tenths"], r["officer_verified"], r["audit_details"]) for r in creation.verified(i, f, e).collect()}
    assert got[2] == (432, True, '{"edited_fields":[],"new_score_tenths":432}') and got[1][2].startswith('{"edited_fields":["mrp"]')
    confidences = spark.createDataFrame([(1, "a", "x", None, 61), (1, "b", "x", None, 60), (1, "c", "x", None, None)], "image_id long, field_name string, value string, status string, confidence int")
    assert {r["field_name"]: r["readability"] for r in field_ops.declaration_rows(confidences).collect()} == {"a": "PASS", "b": "FLAGGED", "c": "FLAGGED"}


def test_payloads_of_any_kind(spark):
    entry = '{"value": 5.5, "confidence": 0.61, "status": "MISSING", "bounding_box": [1, 2, 3, 4], "unit": null}'
    rows = [(1, '{"extracted_fields": {"mrp": ' + entry + ', "a": 1, "b": "x", "c": null, "d": [{"value": 1}], "batch": {}}}'), (2, "{"), (3, None), (4, '{"extracted_fields": [1]}'), (5, "{}")]
    df = spark.createDataFrame(rows, "offline_id long, payload string")
    kinds = {r["field_name"]: r["kind"] for r in payloads.entries(df).collect()}
    assert kinds == {"mrp": "OBJECT", "a": "BIGINT", "b": "STRING", "c": "VOID", "d": "ARRAY", "batch": "OBJECT"}
    got = {r["field_name"]: r for r in payloads.declared(payloads.entries(df)).collect()}
    assert set(got) == {"mrp", "batch"}
    m, b = got["mrp"], got["batch"]
    assert (m["detected_value"], m["is_present"], m["confidence"], m["readability_status"], m["raw_bounding_box"], m["unit"]) == ("5.5", False, 61, "PASS", "[1,2,3,4]", None)
    assert (b["detected_value"], b["is_present"], b["confidence"], b["readability_status"], b["is_officer_edited"]) == (None, True, 90, "FLAGGED", False)
    assert {r["offline_id"]: r["error"] for r in payloads.checked(df).collect()} == {1: None, 2: "INVALID_JSON", 3: "INVALID_JSON", 4: "FIELDS_NOT_AN_OBJECT", 5: None}
