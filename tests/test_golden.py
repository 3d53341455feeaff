"""Vectors worked out by hand for scalars, geometry and rules, and the whole score space."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import scalars as S
from shelfmark.operators import fusion, listings, memos, rules, spatial


def over(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", column(F.col("text")).alias("x")).orderBy("i").collect()
    return [tuple(r["x"]) if r["x"] is not None and isinstance(r["x"], tuple) else r["x"] for r in rows]


def test_quantity(spark):
    cases = {"Net Wt: 500 g": (500.0, "g"), "1.5 Litres": (1.5, "L"), "250 GMS": (250.0, "g"), "20 x 15 cm": None, "10 x 5 g": (5.0, "g"), "10*5 g": None, "5 g x 10": None,
             "60 Sticks": (60.0, "sticks"), "abc": None, None: None, "": None}
    assert over(spark, list(cases), S.parse_quantity) == list(cases.values())


def test_price(spark):
    cases = {"MRP Rs. 150.00": (150.0, "INR"), "₹ 99,50": (99.5, "INR"), "Rs 1,250.00": (1.25, "INR"), "$5": (5.0, "USD"), "0.05": None, "240615": None, "MRP (Incl. taxes)": None,
             "EUR 5": (5.0, "EUR"), "call 1800": None}
    assert over(spark, list(cases), S.parse_mrp) == list(cases.values())


def test_date(spark):
    cases = {"15-08-2026": ("15/08/2026", "exact_date"), "08/12/2026": ("08/12", "exact_date"), "2026.08.15": ("2026/08/15", "exact_date"), "AUG 26": ("AUG 2026", "month_year"),
             "Best Before 24 Months": ("24 months", "relative_duration"), "no date": None}
    got = over(spark, list(cases), S.parse_date)
    want = list(cases.values())
    assert got == want


def test_units_and_currencies(spark):
    assert over(spark, ["Pouches", "LTR", "tablets", "nos"], S.normalize_unit) == ["packs", "L", "tablets", "N"]
    assert over(spark, ["none", "EUR 5", "5 USD"], S.normalize_currency) == ["INR", "EUR", "USD"]
    assert over(spark, ["BARS 50 g"], lambda t: S.has_any(t, ["RS"])) == [True]


def test_evidence(spark):
    df = spark.createDataFrame([("abc", ""), ("abc", None), ("abc", "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"), ("abc", "0")], "t string, c string")
    assert [r["x"]["is_tamper_free"] for r in df.select(S.verify_evidence(F.col("t"), F.col("c")).alias("x")).collect()] == [True, True, True, False]


BOXES = [("₹ 120.00", 50, 100, 140, 130, .95), ("MRP (Incl. taxes)", 150, 100, 260, 130, .96), ("PKD", 50, 160, 100, 185, .94), ("06/2026", 48, 195, 120, 220, .97), ("BATCH NO:", 200, 160, 290, 185, .92),
         ("B240615", 198, 195, 270, 220, .96), ("Best Before 24 Months", 50, 250, 320, 280, .93), ("Net Weight:", 50, 310, 140, 335, .95), ("500 g", 150, 310, 210, 335, .98), ("Some Maker Ltd", 50, 380, 350, 410, .91)]


@pytest.fixture(scope="module")
def boxes(spark):
    return spark.createDataFrame([("a", i, *b) for i, b in enumerate(BOXES)], "image_id string, idx int, text string, x1 long, y1 long, x2 long, y2 long, confidence double")


@pytest.mark.parametrize("extract, want", [
    (spatial.quantity, ("500.0", "g", "HORIZONTAL_RIGHT", 787)), (spatial.mrp, ("120.0", "INR", "HORIZONTAL_LEFT", 722)), (spatial.batch, ("B240615", "code", "VERTICAL_BELOW", 846)),
    (spatial.mfg_date, ("06/2026", "exact_date", "VERTICAL_BELOW", 848)), (spatial.expiry, ("24 months", "relative_duration", "SAME_LINE_COMPOSITE", 960))])
def test_spatial_vector(boxes, extract, want):
    r = extract(boxes).collect()
    assert [(x["value"], x["unit"], x["relation"], x["milli"]) for x in r] == [want]


def test_shifting_and_permuting_change_nothing(boxes):
    moved = boxes.select("image_id", "idx", "text", *((F.col(c) + 1000).alias(c) for c in ("x1", "y1", "x2", "y2")), "confidence")
    two = moved.unionByName(boxes.withColumn("image_id", F.lit("b"))).orderBy(F.desc("idx"))
    for extract in (spatial.quantity, spatial.mrp, spatial.batch, spatial.mfg_date, spatial.expiry):
        want = extract(boxes).drop("image_id").collect()
        assert sorted(extract(two).drop("image_id").collect()) == sorted(want * 2)


FULL = {"product_name": "Tea", "manufacturer_name": "Maker", "manufacturer_address": "12 Long Road, Some City 400001", "net_quantity": "500 g", "mrp": "Rs. 50 (Incl. of all taxes)",
        "manufacturing_date": "08/2026", "consumer_care": "1800-123-4567 care@shop.example", "country_of_origin": "India"}


def vector(changes):
    out = []
    for f, v in (FULL | changes).items():
        if v is not None:
            value, status = v if isinstance(v, tuple) else (v, "CONFIRMED")
            out.append((f, value, value, status))
    return out


V = {"V0": ({}, "COMPLIANT", 1000, 0, False), "V1": (dict.fromkeys(FULL), "NON_COMPLIANT", 432, 65000, True), "V2": ({"net_quantity": "500 GMS"}, "NON_COMPLIANT", 925, 5000, False),
     "V3": ({"manufacturer_address": "short"}, "NEEDS_MANUAL_VERIFICATION", 985, 3000, False), "V4": ({"consumer_care": "1800-123-4567"}, "NEEDS_MANUAL_VERIFICATION", 962, 2500, False),
     "V5": ({"manufacturer_address": "short", "consumer_care": "1800-123-4567"}, "NEEDS_MANUAL_VERIFICATION", 948, 5500, False), "V6": ({"mrp": None, "net_quantity": None}, "NON_COMPLIANT", 750, 30000, True),
     "V7": ({"net_quantity": "250 GMS", "consumer_care": "1800-425-9988"}, "NON_COMPLIANT", 888, 7500, False), "V8": ({k: (v, None) for k, v in FULL.items()}, "NON_COMPLIANT", 432, 65000, True)}


def test_rule_vectors(spark):
    rows = [(name, *f) for name, (changes, *_) in V.items() for f in vector(changes)] + [("V1", "batch_number", "x", "x", "CONFIRMED")]
    fields = spark.createDataFrame(rows, "image_id string, field_name string, value string, raw_text string, status string")
    got = {r["image_id"]: (r["compliance_status"], r["score_tenths"], r["estimated_fee"], r["prosecution_recommended"]) for r in rules.evaluate(rules.wide(fields)).collect()}
    assert got == {k: tuple(v[1:]) for k, v in V.items()}


def test_whole_score_space(spark):
    def sums(c):
        parts = [t.deduction for t in rules.TEMPLATES if t.component == c]
        alone = {"traceability": [(), (30,), (15,), (25,), (30, 25), (15, 25)], "quantity": [(), (50,), (30,)], "mrp": [(), (50,), (25,)], "care": [(), (50,), (25,)]}
        return sorted({100 - sum(x) for x in alone.get(c, [s for n in range(len(parts) + 1) for s in itertools.combinations(parts, n)])})

    space = list(itertools.product(*(sums(c) for c in rules.WEIGHTS)))
    assert len(space) == 1296
    df = spark.createDataFrame(space, ", ".join(f"{c} int" for c in rules.WEIGHTS)).selectExpr("*", "0 AS critical_violations", "0 AS high_violations", "0 AS violations_count")
    for r in rules.finish(df).collect():
        exact = round(.25 * r["mandatory"] + .25 * r["quantity"] + .25 * r["mrp"] + .15 * r["care"] + .10 * r["traceability"], 1)
        assert r["score_tenths"] == round(exact * 10)


def test_repeat_offenders_without_a_store(spark):
    df = spark.createDataFrame([(1, None, "NON_COMPLIANT"), (2, None, "NON_COMPLIANT"), (3, 5, "NON_COMPLIANT"), (4, 5, "COMPLIANT"), (5, 6, "COMPLIANT")], "inspection_id long, store_id long, compliance_status string")
    assert sorted(map(tuple, memos.repeat_offenders(df).collect())) == [(1, True), (2, True), (3, False), (4, True), (5, False)]


def test_compounding_default(spark):
    df = spark.createDataFrame([(0,), (None,), (2500,)], "a int")
    assert [int(r[0]) for r in df.select(memos.compounding(F.col("a"))).collect()] == [5000, 5000, 2500]


def test_empty_registry(spark):
    from shelfmark.plans.summary_queries import admin_summary
    i = spark.createDataFrame([], "inspection_id long, compliance_status string, fee decimal(18,2)")
    v = spark.createDataFrame([], "severity string")
    r = admin_summary(i, v).first()
    assert (r["compliance_rate_tenths"], int(r["total_fee"])) == (1000, 0)


def test_filters_that_are_off(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "s string, officer_id long")
    assert all(listings.equal_or_all(df, "s", x).count() == 2 for x in (None, "", "ALL")) and listings.equal_or_all(df, "s", "A").count() == 1
    users = spark.createDataFrame([(1, "L1")], "user_id long, officer_code string")
    assert listings.by_officer(df, users, "nobody").count() == 2 and listings.by_officer(df, users, "L1").count() == 1


def test_iou():
    assert fusion.iou((0, 0, 1, 1), (5, 5, 6, 6)) == 0 and fusion.iou((0, 0, 4, 4), (0, 0, 4, 4)) == 1 and fusion.iou((0, 0, 0, 0), (0, 0, 0, 0)) == 0


def test_fusion_is_greedy_and_not_transitive(spark):
    rows = [("a", "e1", 0, "NET QTY 500 g", 0, 0, 100, 20, .9), ("a", "e2", 0, "NET QTY 5OO g", 2, 1, 101, 21, .8), ("a", "e3", 0, "", 1, 0, 100, 20, .99),
            ("a", "e1", 1, "MRP Rs 50", 0, 60, 100, 80, .7), ("b", "e1", 0, "", 0, 0, 10, 10, .9)]
    boxes = spark.createDataFrame(rows, "image_id string, engine string, idx int, text string, x1 long, y1 long, x2 long, y2 long, confidence double")
    got = {(r["image_id"], r["text"]): (r["engines"], r["agreement"], r["x1"], r["y2"]) for r in fusion.fused(fusion.clusters(boxes)).collect()}
    assert got == {("a", "NET QTY 500 g"): ("e1,e2,e3", 3, 0, 21), ("a", "MRP Rs 50"): ("e1", 1, 0, 80)}


def test_text_similarity(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("A", "a"), (None, "x"), ("", "")], "a string, b string")
    assert [r["similarity"] for r in fusion.text_similarity(df, "a", "b").collect()] == [0.75, 1.0, 0.0, 1.0]


def test_labels_by_hand(spark):
    """Label texts and what they are labels of, written down without the patterns."""
    cases = {
        "NET QTY: 500 g": {"quantity"}, "Contents": {"quantity"}, "stick count": {"quantity"}, "INTERNET": set(), "M.R.P. 20": {"mrp"}, "Incl of all taxes": {"mrp"},
        "BATCH NO. 7": {"batch"}, "B. No": {"batch"}, "LOT": {"batch"}, "ballot": set(), "MFG DATE": {"mfg_date"}, "Packed": {"mfg_date"}, "MFG/PKG DATE": {"mfg_date"}, "month & year of packing": {"mfg_date"},
        "EXP. DT.": {"expiry"}, "Best  Before End": {"expiry"}, "expert": set(), "MFD BY: X": {"manufacturer", "mfg_date"}, "Imported by": {"manufacturer"}, "Mfg in India by": {"manufacturer", "mfg_date"},
        "Customer service": {"care"}, "HELPLINE": {"care"}, "Made in": {"origin"}, "Country of Origin": {"origin"}, "Manufactured in": {"origin", "mfg_date"}, "nothing": set()}
    df = spark.createDataFrame([(t,) for t in cases], "text string").select("text", *(S.found(F.col("text"), p).alias(k) for k, p in S.P.LABELS.items()))
    assert {r["text"]: {k for k in S.P.LABELS if r[k]} for r in df.collect()} == cases


def test_json_and_evidence_by_hand(spark):
    texts = ['{"a": 1}', "not json", "[1", "[1]", "", None]
    assert over(spark, texts, S.is_json) == [True, False, False, True, False, None]
    assert over(spark, ['say ```json\n{"a": 1}\n``` end', "```\n[1]\n```", "  x ", "```json {}", None], S.unfenced) == ['\n{"a": 1}\n'.strip(), "[1]", "x", "{}", None]
    latin, beyond = "prix: café", "₹ 5 café"
    assert [r[0] for r in over(spark, [latin, beyond], lambda t: S.verify_evidence(t, F.lit("")))] == [
        hashlib.sha256(latin.encode("latin1")).hexdigest(), hashlib.sha256(beyond.encode()).hexdigest()]


def test_fused_rows_and_means_by_hand(spark):
    rows = [("a", "x", 0, "MRP 20", 10, 100, 90, 120, .9), ("a", "y", 0, "MRP 2O", 12, 101, 91, 121, .6), ("a", "x", 1, "Net 5 g", 10, 10, 90, 30, .5), ("a", "y", 1, "", 300, 400, 310, 410, .5)]
    boxes = spark.createDataFrame(rows, "image_id string, engine string, idx int, text string, x1 long, y1 long, x2 long, y2 long, confidence double")
    got = [(r["text"], r["confidence"], r["source_model"], r["engines"], r["place"]) for r in fusion.fused(fusion.clusters(boxes)).orderBy("place").collect()]
    assert got == [("Net 5 g", .5, "x", "x", 0), ("MRP 20", .9, "x", "x,y", 1)]
    stats = {(r["engine"], r["boxes"], r["mean_milli"]) for r in fusion.engine_stats(boxes, ["x", "y", "z"]).collect()}
    assert stats == {("x", 2, 700), ("y", 2, 550), ("z", 0, 0)}
    assert fusion.with_layout(boxes, "x").where("engine = 'layout'").count() == 2
    for a, b in itertools.product(["mrp 20", "mrp 2o", "", "net", "20 mrp"], repeat=2):
        assert fusion.alike(a, b, 0.4) == (fusion.similarity(a, b) > 0.4)


def test_review_marks_changes_alone(spark):
    from shelfmark.operators import fields as ops

    f = spark.createDataFrame([(1, "mrp", "5", "MISSING", 30), (1, "batch", "b", None, 40), (1, "care", None, None, None)], "image_id int, field_name string, value string, status string, confidence int")
    e = spark.createDataFrame([(1, "mrp", "6"), (1, "batch", "b"), (1, "care", "x")], "image_id int, field_name string, edit string")
    got = {r["field_name"]: tuple(r)[2:] for r in ops.verified_declarations(f, e).collect()}
    assert got == {"mrp": ("6", True, 100), "batch": ("b", False, 40), "care": ("x", True, 100)}
    assert {r["field_name"]: r["status"] for r in ops.reevaluated(f, e.limit(0)).collect()} == {"mrp": "CONFIRMED", "batch": "CONFIRMED", "care": "MISSING"}
