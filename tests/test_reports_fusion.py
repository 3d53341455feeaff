"""The report sink through deletions, and fusion against the plain greedy search."""

import os
import random
import shutil

from pyspark.sql import functions as F

from shelfmark.operators import fields as field_ops
from shelfmark.operators import fusion, reports

FIELDS = "image_id long, field_name string, value string, raw_text string, status string, confidence int, source_model string"


def some(spark, n):
    inspections = spark.createDataFrame([(i, f"INSP-{i}", "STR-1", "Food") for i in range(n)], "image_id long, inspection_number string, store_code string, category string")
    rows = [(i, f, "x" * 60, "x", "CONFIRMED" if i % 2 else None, 80, "a source of a long name") for i in range(n) for f in ("mrp", "product_name")[: i % 3]]
    return reports.documents(inspections, spark.createDataFrame(rows, FIELDS))


def test_reports_say_what_is_there_and_what_is_not(spark):
    got = {r["inspection_number"]: r for r in some(spark, 4).collect()}
    assert got["INSP-0"]["product_name"] == "Packaged Commodity" and len(got["INSP-0"]["violations"]) == 8 and got["INSP-0"]["compounding_fee"] == "₹65,000"
    assert got["INSP-0"]["prosecution"].startswith("YES") and [d["compliance"] for d in got["INSP-0"]["declarations"]] == ["FLAGGED / MISSING"] * 9
    mrp = {d["declaration"]: d for d in got["INSP-1"]["declarations"]}["MRP (Incl. of all taxes) (6(1)(e))"]
    assert (len(mrp["value"]), mrp["source"], mrp["confidence"], mrp["compliance"]) == (45, "a source of a long n", "80.0%", "PASS")


def test_only_missing_reports_are_written(spark, tmp_path):
    path, docs = f"{tmp_path}/reports", some(spark, 60)
    want = sorted(map(str, docs.collect()))
    files = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".json")}
    assert sorted(map(str, reports.written(docs.where("crc32(inspection_number) % 2 = 0"), path).collect())) != want
    assert sorted(map(str, reports.written(docs, path).collect())) == want
    before = files()
    gone = sorted(d for d in os.listdir(path) if d.startswith("bucket="))[:5]
    for d in gone:
        shutil.rmtree(f"{path}/{d}")
    assert sorted(map(str, reports.written(docs, path).collect())) == want
    after = files()
    kept = {f: t for f, t in before.items() if not any(f"/{d}/" in f for d in gone)}
    assert kept.items() <= after.items() and all(any(f"/{d}/" in f for d in gone) for f in after.keys() - kept.keys())
    reports.written(docs, path)
    assert files() == after  # nothing is missing, nothing is written


def test_external_findings(spark):
    f = spark.createDataFrame([(1, "mrp", "5", "raw", "LOW_CONFIDENCE", 40), (1, "batch", "b", "b", "CONFIRMED", None), (2, "mrp", None, None, None, None)], "image_id long, field_name string, value string, raw_text string, status string, confidence int")
    v = spark.createDataFrame([(1, "mrp", "6", "", "CONFLICTING", "blurred"), (2, "mrp", None, "seen", "", "")], "image_id long, field_name string, seen string, seen_raw string, seen_status string, seen_notes string")
    got = {(r["image_id"], r["field_name"]): tuple(r)[2:] for r in field_ops.external_merge(f, v).collect()}
    assert got == {(1, "mrp"): ("6", "raw", 95, "CONFLICTING", "blurred", "EnsembleOCR+External"), (1, "batch"): ("b", "b", None, "CONFIRMED", None, "EnsembleOCR"),
                   (2, "mrp"): (None, "seen", 95, None, None, "EnsembleOCR+External")}


def plain_clusters(boxes):
    """The greedy search of one image, box by box."""
    boxes = sorted(boxes, key=lambda b: (b["y1"], b["x1"], b["engine"], b["idx"]))
    cluster = [None] * len(boxes)
    at = lambda b: (b["x1"], b["y1"], b["x2"], b["y2"])
    for i, a in enumerate(boxes):
        if cluster[i] is None:
            cluster[i] = i
            for j, b in enumerate(boxes):
                if cluster[j] is None:
                    tall = max(0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])) / (min(a["y2"] - a["y1"], b["y2"] - b["y1"]) + 1e-5)
                    if fusion.iou(at(a), at(b)) > 0.35 or (tall > 0.65 and fusion.similarity(a["text"] or "", b["text"] or "") > 0.4):
                        cluster[j] = i
    return [(b["image_id"], b["engine"], b["idx"], c, i) for i, (b, c) in enumerate(zip(boxes, cluster, strict=True))]


def test_sweep_gives_what_the_greedy_search_gives(spark):
    rnd = random.Random(4)
    words, rows = ["NET QTY", "NET OTY", "MRP 20", "MRP 2O", "Batch", "", None, "made in"], []
    for image in [*range(40), None]:
        for i in range(rnd.randrange(1, 60) if image != 7 else 400):
            x, y = rnd.randrange(-50, 300), rnd.randrange(-20, 200)
            rows.append((image, rnd.choice("abc"), i, rnd.choice(words), x, y, x + rnd.randrange(0, 90), y + rnd.randrange(0, 30), .5))
    boxes = spark.createDataFrame(rows, "image_id long, engine string, idx int, text string, x1 long, y1 long, x2 long, y2 long, confidence double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # images go on from batch to batch
    try:
        got = sorted(((r["image_id"], r["engine"], r["idx"], r["cluster"], r["place"]) for r in fusion.clusters(boxes).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    images = {}
    for r in boxes.collect():
        images.setdefault(r["image_id"], []).append(r)
    assert got == sorted((x for image in images.values() for x in plain_clusters(image)), key=str)
    assert fusion.clusters(boxes.limit(0)).count() == 0
