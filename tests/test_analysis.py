"""From boxes to evaluation, and the spatial join: worked out by hand, and against all pairs."""

import math
import random

from pyspark.sql import functions as F

from shelfmark.operators import analysis, spatial

SCHEMA = "image_id string, idx int, text string, x1 long, y1 long, x2 long, y2 long, confidence double"
BOXES = [("₹ 120.00", 50, 100, 140, 130, .95), ("MRP (Incl. taxes)", 150, 100, 260, 130, .96), ("PKD", 50, 160, 100, 185, .94), ("06/2026", 48, 195, 120, 220, .97), ("BATCH NO:", 200, 160, 290, 185, .92),
         ("B240615", 198, 195, 270, 220, .96), ("Best Before 24 Months", 50, 250, 320, 280, .93), ("Net Weight:", 50, 310, 140, 335, .95), ("500 g", 150, 310, 210, 335, .98), ("Some Maker Ltd", 50, 380, 350, 410, .91)]


def images(spark, *labels):
    rows = [(chr(97 + i), j, *b) for i, label in enumerate(labels) for j, b in enumerate(label)]
    codes = spark.createDataFrame([], "image_id string, seq int, type string, data string")
    return analysis.analyzed(spark.createDataFrame(rows, SCHEMA), codes)


def test_spatial_vector_to_evaluation(spark):
    got = {r["field_name"]: r for r in analysis.entries(images(spark, BOXES)).collect()}
    assert list(got) == analysis.ENTRIES
    want = {"net_quantity": ("500.0", "g", "HORIZONTAL_RIGHT", 787), "mrp": ("120.0", "INR", "HORIZONTAL_LEFT", 722), "batch_number": ("B240615", None, "VERTICAL_BELOW", 846),
            "manufacturing_date": ("06/2026", "packing_date", "VERTICAL_BELOW", 848), "expiry_date": ("24 months", "relative_duration", "SAME_LINE_COMPOSITE", 960), "barcode_or_qr": (None, None, "NONE", 0),
            "currency": ("INR", None, "HORIZONTAL_LEFT", 722), "product_name": ("₹ 120.00", None, "TOP_HEADER_PROMINENCE", 950), "brand_name": ("₹", None, "TOP_HEADER_PROMINENCE", 950),
            "manufacturer_name": (None, None, "NONE", 0), "manufacturer_address": (None, None, "NONE", 0), "consumer_care": (None, None, "NONE", 0), "country_of_origin": (None, None, "NONE", 0),
            "other_declarations": (None, None, "DECLARATION_BLOCK", 0)}
    assert {f: (r["value"], r["detail"], r["spatial_relationship"], r["confidence_milli"]) for f, r in got.items()} == want | {"manufacturing_date": ("06/2026", "packing_date", "VERTICAL_BELOW", 848)}
    assert got["mrp"]["raw_text"] == "MRP (Incl. taxes) | ₹ 120.00" and got["net_quantity"]["raw_text"] == "Net Weight: -> 500 g"
    assert got["expiry_date"]["bounding_box"] == [50, 250, 320, 280] and got["barcode_or_qr"]["bounding_box"] == [0, 0, 0, 0]
    r = analysis.evaluated(images(spark, BOXES)).first()
    # maker, address, care and origin are missing: 25 of mandatory, 50 of care, 55 of traceability
    assert (r["compliance_status"], r["score_tenths"], r["violations_count"], r["estimated_fee"], r["missing"]) == ("NON_COMPLIANT", 808, 4, 20000, 6)


def test_the_two_labels_of_the_image_tests(spark):
    lines = lambda *texts: [(t, 60, 100 + 60 * i, 60 + 9 * len(t), 124 + 60 * i, .9) for i, t in enumerate(texts)]
    good = lines("HERITAGE STICKS", "NET QTY: 120 g (60 Sticks)", "MRP Rs. 150.00 (Incl. of all taxes)", "BATCH NO: MK-2026-09A", "MFG DATE: 08/2026", "EXP DATE: 08/2028 (Best Before 24 Months)",
                 "MFD BY: Maker Works", "Plot 12, Industrial Estate, Pune 411001", "CONSUMER CARE: 1800-123-4567 | care@shop.example", "COUNTRY OF ORIGIN: INDIA")
    bad = lines("FAST TEA", "NET QTY: 250 GMS", "MRP Rs. 85.00 (Incl. of all taxes)", "BATCH NO: AM-2026-CH04", "PKD DATE: 07/2026", "BEST BEFORE 12 MONTHS FROM PACKING", "MFD BY: Some Foods",
                "12 Some Road", "CONSUMER GRIEVANCE: 1800-425-9988", "COUNTRY OF ORIGIN: INDIA")
    both = images(spark, good, bad)
    rows = {r["image_id"]: r for r in analysis.evaluated(both).collect()}
    assert (rows["a"]["compliance_status"], rows["a"]["score_tenths"], rows["a"]["estimated_fee"]) == ("COMPLIANT", 1000, 0)
    entries = {(r["image_id"], r["field_name"]): r for r in analysis.entries(both).collect()}
    assert entries["a", "manufacturer_address"]["value"] == "Plot 12, Industrial Estate, Pune 411001" and entries["a", "manufacturer_address"]["confidence_milli"] == 810
    assert rows["b"]["compliance_status"] == "NON_COMPLIANT" and entries["b", "net_quantity"]["value"] == "250.0"
    # GMS, no e-mail, and an address of fewer than 15 characters
    assert (rows["b"]["score_tenths"], rows["b"]["estimated_fee"]) == (872, 10500)


def test_zero_quantity_hints_over_boxes_and_odd_texts(spark):
    row = lambda *texts: [(t, 10, 40 * i, 90, 40 * i + 20, .5) for i, t in enumerate(texts)]
    both = images(spark, row("NET QTY 0 g", "TAMIL", "NADU"), row(None, "", "  "), row("BARS 50 g", "₹ 5", "40 ml"))
    e = {(r["image_id"], r["field_name"]): r for r in analysis.entries(both).collect()}
    assert e["a", "net_quantity"]["value"] == "0.0" and e["a", "country_of_origin"]["spatial_relationship"] == "INFERRED_FROM_ADDRESS"
    assert all(e["b", f]["value"] is None for f in analysis.ENTRIES if f != "currency")
    assert (e["c", "net_quantity"]["value"], e["c", "net_quantity"]["spatial_relationship"]) == ("40.0", "STANDALONE_QUANTITY_MATCH")
    assert (e["c", "mrp"]["value"], e["c", "mrp"]["confidence_milli"], e["c", "mrp"]["spatial_relationship"]) == ("50.0", 440, "STANDALONE_CURRENCY_PRICE")  # BARS holds RS
    v = {r["image_id"]: r["violations_count"] for r in analysis.evaluated(both).collect()}
    assert v["b"] == 8  # all that must be declared is missing


def test_boxes_are_shuffled_once(spark):
    df = analysis.evaluated(images(spark, BOXES))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") >= 1  # the pairs read the boxes that the single entries read


def scattered(spark, n, seed, tall=0):
    rnd = random.Random(seed)
    side = int(40 * math.sqrt(n))
    rows = []
    for i in range(n):
        x, y, h = rnd.randrange(side), rnd.randrange(side), tall if tall and i % 500 == 0 else rnd.randrange(12, 30)
        rows.append(("a" if i % 3 else "b", i, "l" if i % 4 == 0 else "v", x, y, x + rnd.randrange(20, 200), y + h, rnd.random()))
    boxes = spatial.measured(spark.createDataFrame(rows, SCHEMA))
    return boxes.where("text = 'l'"), boxes.where("text = 'v'")


def test_grid_gives_what_all_pairs_give(spark):
    for n, tall in ((120, 0), (3000, 0), (3000, 300)):
        labels, values = scattered(spark, n, n, tall)
        every = spatial.with_relation(spatial.side(labels, "l").join(spatial.side(values, "v"), "image_id").where("l_idx <> v_idx")).where(F.col("norm") <= spatial.FARTHEST)
        key = ["image_id", "l_idx", "v_idx", "relation"]
        assert sorted(spatial.candidates(labels, values).select(key).collect()) == sorted(every.select(key).collect())


def test_pairs_grow_with_neighbours(spark):
    few, many = (spatial.in_reach(*scattered(spark, n, 1)).count() for n in (5_000, 20_000))
    assert many < 6 * few  # four times the boxes on four times the room; all pairs would be sixteen times as many
