"""From the text boxes of a label to its fourteen field entries and their evaluation, in one plan.

Every box is classified once: which labels it holds, and which values. The boxes are then dealt by image, and that one
shuffle serves both what a single box tells (values beside their label, names, care, origin) and the pairs of a label with
a value of the same kind around it, which meet in one join keyed by image, kind and grid cell. One arg-min of structs
picks each kind's pair. All that is known of an image comes together in one row, which the rules read as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions import scalars as S
from shelfmark.operators import rules, spatial

KINDS = ["quantity", "mrp", "batch", "mfg_date", "expiry"]
# The most that a value on its label's own line is sure of, the factors of values that have no label, and other confidences, all in thousandths.
CAPS = {"quantity": 980, "mrp": 990, "batch": 960, "mfg_date": 980, "expiry": 960}
FALLBACKS = {"quantity": (0.85, "STANDALONE_QUANTITY_MATCH"), "mrp": (0.88, "STANDALONE_CURRENCY_PRICE")}
JOINERS = {"mrp": " | "}
CURRENCY_MILLI, INFERRED_MILLI, CODE_MILLI, OTHER_MILLI, ADDRESS_FACTOR = 500, 850, 990, 800, 0.9
ORIGIN_HINTS = ["INDIA", "PIN", "DELHI", "BENGALURU", "MUMBAI", "KARNATAKA", "TAMIL NADU", "GUJARAT"]
ENTRIES = ["net_quantity", "mrp", "currency", "batch_number", "manufacturing_date", "expiry_date", "manufacturer_name", "manufacturer_address", "product_name", "brand_name",
           "consumer_care", "country_of_origin", "barcode_or_qr", "other_declarations"]
_BOX = ["text", "x1", "y1", "x2", "y2", "confidence", "source_model"]
_milli = lambda c: F.round(c * 1000).cast("long")


#: What a box may be, each a bit of ``flags``; and what it may say, each a place in ``said``.
FLAGS = [*KINDS, "manufacturer", "care", "origin", "place", "title", "alone_quantity", "alone_mrp"]
SAID = ["quantity", "mrp", "date", "batch", "own_batch", "other"]


def classified(boxes: DataFrame) -> DataFrame:
    """Boxes (image_id, idx, text, x1, y1, x2, y2, confidence, and source_model or the ensemble) with ``flags`` and ``said``.

    ``said`` has (value, unit) for each of SAID; ``own_batch`` is the code on a batch label's own line. Both are single
    columns, so that all that comes after reads the same columns and shares one shuffle.
    """
    if "source_model" not in boxes.columns:
        boxes = boxes.withColumn("source_model", F.lit("EnsembleOCR"))
    t = F.col("text")
    boxes = boxes.where("image_id IS NOT NULL").select("image_id", F.col("idx").cast("long").alias("idx"), F.btrim(t, F.lit(" \t\n\r\x0b\x0c")).alias("text"), *_BOX[1:])
    holds = {k: S.found(t, P.LABELS[k]) for k in (*KINDS, "manufacturer", "care", "origin")}
    holds["mfg_date"] &= ~S.has_any(t, ["EXP", "BEST BEFORE", "USE BY"])
    holds["care"] |= t.rlike(P.any_of(P.CARE_MARKS))
    holds |= {"place": S.has_any(t, P.PLACES), "title": (F.length(t) > 3) & ~S.has_any(t, P.PRODUCT_REJECTS),
              "alone_quantity": ~S.has_any(t, P.QUANTITY_REJECTS), "alone_mrp": t.rlike(P.any_of(["₹", "Rs.", "RS", "INR"]))}
    pair = lambda c: F.when(c.isNotNull(), F.struct(c["value"].cast("string").alias("value"), c["unit"].alias("unit")))
    plain = lambda c: F.when(c.isNotNull(), F.struct(c.alias("value"), F.lit(None).cast("string").alias("unit")))
    flags = sum((F.when(holds[name], 1 << i).otherwise(0) for i, name in enumerate(FLAGS)), F.lit(0))
    said = F.array(pair(S.parse_quantity(t)), pair(S.parse_mrp(t)), pair(S.parse_date(t)), plain(S.batch_value(t)), plain(S.clean_batch(t)), plain(S.other_declaration(t)))
    return boxes.withColumns({"flags": flags, "said": said})


def _is(name: str) -> Column:
    return F.col("flags").bitwiseAND(1 << FLAGS.index(name)) != 0


def _says(name: str) -> Column:
    return F.get("said", F.lit(SAID.index(name)))


def _as_one(dealt: DataFrame) -> DataFrame:
    """``dealt`` behind a filter that lets every row pass.

    Each of the steps that read it needs other columns, and would push its own choice of them below the shuffle, so that
    boxes would be classified and shuffled once a step. A filter on all columns that isn't deterministic is passed by
    neither columns nor conditions; the steps then ask for the same shuffle, and Spark makes it once.
    """
    return dealt.where(F.xxhash64(*dealt.columns) + F.rand(0) > F.lit(-1e19))  # no hash is as small


def _near(kind: str) -> Column:
    return _says("date" if kind in ("mfg_date", "expiry") else kind)


def _own(kind: str) -> Column:
    return _says("own_batch") if kind == "batch" else _near(kind)


def _zero() -> Column:
    return F.array(*(F.lit(0).cast("long") for _ in range(4)))


_box = lambda p="": F.array(*(F.col(f"{p}{c}").cast("long") for c in ("x1", "y1", "x2", "y2")))


def _pairs(seen: DataFrame) -> DataFrame:
    """image_id and of each kind (near_kind) the best pair of its first label that has neither a value of its own nor none around it."""
    role = lambda holds, kind, *more: F.when(holds, F.struct(F.lit(kind).alias("kind"), *more))
    kept = ["image_id", "idx", *_BOX, "_n", "_tall"]
    some = lambda roles: F.explode(F.filter(F.array(*roles), lambda r: r.isNotNull()))
    labels = seen.select(*kept, some([role(_is(k) & _own(k).isNull(), k) for k in KINDS]).alias("r")).select(*kept, "r.kind")
    values = seen.select(*kept, some([role(_near(k).isNotNull(), k, _near(k).alias("said")) for k in KINDS]).alias("r")).select(*kept, "r.kind", "r.said")
    found = spatial.candidates(labels, values, ["kind"])
    pick = F.struct(F.col("l_idx"), (-F.col("milli")).alias("o"), F.col("v_idx"), F.col("v_said").alias("said"), F.col("milli"), _milli(F.col("v_confidence")).alias("ocr_milli"), F.col("relation"),
                    F.col("l_text").alias("label"), F.col("v_text").alias("text"), F.col("v_source_model").alias("source_model"), _box("v_").alias("box"))
    return found.groupBy("image_id").agg(*(F.min(F.when(F.col("kind") == k, pick)).alias(f"near_{k}") for k in KINDS))


def _entry(value, raw, milli, ocr_milli, source, box, relation, status, detail=None) -> Column:
    as_col = lambda x, kind="string": (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(as_col(value).alias("value"), as_col(raw).alias("raw_text"), as_col(milli, "long").alias("confidence_milli"), as_col(ocr_milli, "long").alias("ocr_milli"), as_col(source).alias("source_model"),
                    box.alias("bounding_box"), as_col(relation).alias("spatial_relationship"), as_col(status).alias("status"), as_col(detail).alias("detail"))


def _missing(source="None", relation="NONE", detail=None) -> Column:
    return _entry(None, None, 0, 0, source, _zero(), relation, "MISSING", detail)


def _paired(kind: str, detail=lambda said, label: said["unit"], none=None) -> Column:
    """A kind's entry from its value beside the first label, its best pair, or a value that stands alone."""
    own, near, alone = F.col(f"own_{kind}"), F.col(f"near_{kind}"), F.col(f"alone_{kind}") if kind in FALLBACKS else None
    status = lambda m: F.when(m >= spatial.SURE, "CONFIRMED").otherwise("LOW_CONFIDENCE")
    one = lambda b, milli, relation: _entry(b["said"]["value"], b["text"], milli, _milli(b["confidence"]), b["source_model"], b["box"], relation, status(milli), detail(b["said"], b["text"]))
    sure = F.least(F.lit(CAPS[kind]), _milli(own["confidence"] * 1.05))
    entry = F.when(own.isNotNull() & (near.isNull() | (own["idx"] < near["l_idx"])), one(own, sure, "SAME_LINE_COMPOSITE")).when(near.isNotNull(), _entry(
        near["said"]["value"], F.concat(near["label"], F.lit(JOINERS.get(kind, " -> ")), near["text"]), near["milli"], near["ocr_milli"], near["source_model"], near["box"], near["relation"],
        status(near["milli"]), detail(near["said"], near["label"])))
    if alone is not None:
        factor, name = FALLBACKS[kind]
        entry = entry.when(alone.isNotNull(), one(alone, _milli(alone["confidence"] * factor), name))
    return entry.otherwise(_missing(detail=none))


def _without_label(text: Column, kind: str) -> Column:
    return F.btrim(F.replace(F.regexp_replace(text, "(?i)" + P.LABELS[kind], ""), F.lit(":"), F.lit("")))


def analyzed(boxes: DataFrame, codes: DataFrame) -> DataFrame:
    """One row an image: image_id and a struct column for each of ENTRIES. ``codes`` (image_id, seq, type, data) are decoded symbols.

    An entry has value, raw_text, confidence and OCR confidence in thousandths, source_model, bounding_box, spatial
    relationship, status, and in ``detail`` its unit, currency or type of date. An image with boxes of any number and
    kind gives a row; null texts are none of the kinds, and boxes without an image are left out.
    """
    dealt = spatial.measured(_as_one(classified(boxes).repartition("image_id")))
    image = Window.partitionBy("image_id")
    first = lambda holds, *order: F.min(F.when(holds, F.struct(*order, "idx", *(c for c in _BOX if c not in order), _box().alias("box"))))
    spoken = lambda holds, said: F.min(F.when(holds, F.struct("idx", said.alias("said"), "text", "confidence", "source_model", _box().alias("box"))))
    made = dealt.withColumn("_maker", first(_is("manufacturer")).over(image))
    mid = lambda a, b, p=None: ((F.col(a) if p is None else p[a]) + (F.col(b) if p is None else p[b])) / 2.0
    m = F.col("_maker")
    size = lambda a, b, p=None: F.greatest(F.lit(1), (F.col(b) - F.col(a)) if p is None else (p[b] - p[a]))
    down = mid("y1", "y2") - mid("y1", "y2", m)
    below = (_is("place") & (F.col("idx") != m["idx"]) & (down > 0) & (down <= size("y1", "y2", m) * 5.0)
             & (F.abs(mid("x1", "x2") - mid("x1", "x2", m)) <= F.greatest(size("x1", "x2", m), size("x1", "x2")) * 1.5))
    listed = lambda holds, c: F.transform(F.sort_array(F.collect_list(F.when(holds, F.struct("idx", c.alias("t"))))), lambda x: x["t"])
    single = made.groupBy("image_id").agg(
        *(spoken(_is(k) & _own(k).isNotNull(), _own(k)).alias(f"own_{k}") for k in KINDS),
        *(spoken(_is(f"alone_{k}") & _near(k).isNotNull(), _near(k)).alias(f"alone_{k}") for k in FALLBACKS),
        F.min("_maker").alias("maker"), F.array_join(listed(below, F.col("text")), ", ").alias("address"), first(_is("title"), "y1", "x1").alias("title"), first(_is("care")).alias("care"),
        first(_is("origin")).alias("origin"), F.array_join(listed(_says("other").isNotNull(), _says("other")["value"]), "; ").alias("others"),
        F.upper(F.array_join(listed(F.lit(True), F.col("text")), " ")).rlike(P.any_of(ORIGIN_HINTS)).alias("hint"))
    code = codes.groupBy("image_id").agg(F.min(F.struct("seq", "type", "data")).alias("code"))
    row = single.join(_pairs(dealt), "image_id", "left").join(code, "image_id", "left")

    maker, title, care, origin, code = (F.col(c) for c in ("maker", "title", "care", "origin", "code"))
    name = F.coalesce(F.nullif(_without_label(maker["text"], "manufacturer"), F.lit("")), F.lit("Manufactured on Package"))
    address = F.nullif(F.col("address"), F.lit(""))
    seen = lambda b, value, relation: _entry(value, b["text"], _milli(b["confidence"]), _milli(b["confidence"]), b["source_model"], b["box"], relation, "CONFIRMED")
    part = _milli(maker["confidence"] * ADDRESS_FACTOR)
    packed = lambda said, label: F.when(S.has_any(label, ["PKD", "PACKED", "PACKING"]), "packing_date").otherwise("manufacturing_date")
    mrp = F.col("mrp")
    row = row.select("*", _paired("mrp").alias("mrp")).withColumns({
        "net_quantity": _paired("quantity"),
        "currency": F.when(mrp["value"].isNotNull(), _entry(mrp["detail"], mrp["raw_text"], mrp["confidence_milli"], mrp["ocr_milli"], mrp["source_model"], mrp["bounding_box"], mrp["spatial_relationship"], "CONFIRMED"))
        .otherwise(_entry("INR", None, CURRENCY_MILLI, 0, "Default", _zero(), "DEFAULT", "LOW_CONFIDENCE")),
        "batch_number": _paired("batch"),
        "manufacturing_date": _paired("mfg_date", packed, "unknown"),
        "expiry_date": _paired("expiry", lambda said, label: F.when(said["unit"] == "relative_duration", said["unit"]).otherwise("exact_date"), "unknown"),
        "manufacturer_name": F.when(maker.isNotNull(), seen(maker, name, "VERTICAL_STACK_BLOCK")).otherwise(_missing()),
        "manufacturer_address": F.when(maker.isNotNull(), _entry(F.coalesce(address, name), maker["text"], part, part, maker["source_model"], maker["box"], "VERTICAL_STACK_BLOCK",
                                                                 F.when(address.isNotNull(), "CONFIRMED").otherwise("LOW_CONFIDENCE"))).otherwise(_missing()),
        "product_name": F.when(title.isNotNull(), seen(title, title["text"], "TOP_HEADER_PROMINENCE")).otherwise(_missing()),
        "brand_name": F.when(title.isNotNull(), seen(title, F.split(title["text"], r"\s+").getItem(0), "TOP_HEADER_PROMINENCE")).otherwise(_missing()),
        "consumer_care": F.when(care.isNotNull(), seen(care, care["text"], "SAME_LINE_COMPOSITE")).otherwise(_missing()),
        "country_of_origin": F.when(origin.isNotNull(), seen(origin, F.coalesce(F.nullif(_without_label(origin["text"], "origin"), F.lit("")), F.lit("India")), "SAME_LINE_COMPOSITE"))
        .when(F.col("hint"), _entry("India", "Manufactured in India (Inferred from address)", INFERRED_MILLI, INFERRED_MILLI, "SpatialInference", F.coalesce(maker["box"], _zero()), "INFERRED_FROM_ADDRESS", "CONFIRMED"))
        .otherwise(_missing()),
        "barcode_or_qr": F.when(code.isNotNull(), _entry(F.concat_ws(": ", code["type"], code["data"]), code["data"], CODE_MILLI, CODE_MILLI, "BarcodeScanner", _zero(), "SCANNED_OPTICAL_CODE", "CONFIRMED"))
        .otherwise(_missing("BarcodeScanner")),
        "other_declarations": F.when(F.col("others") != "", _entry(F.col("others"), F.col("others"), OTHER_MILLI, OTHER_MILLI, "EnsembleOCR", _zero(), "DECLARATION_BLOCK", "CONFIRMED"))
        .otherwise(_missing("EnsembleOCR", "DECLARATION_BLOCK"))})
    return row.select("image_id", *ENTRIES)


def entries(images: DataFrame) -> DataFrame:
    """The fourteen entries of each image as rows."""
    every = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("e")) for f in ENTRIES))
    return images.select("image_id", F.explode(every).alias("x")).select("image_id", "x.field_name", "x.e.*")


def evaluated(images: DataFrame) -> DataFrame:
    """One row an image: how many entries are confirmed, unsure and missing, the sum of their confidences, and the rules' verdict.

    A row has all its entries, so nothing is shuffled. A quantity of zero counts as missing, as an empty value does.
    """
    value = lambda f: F.when(F.col(f"{f}.value").try_cast("double") == 0, "").otherwise(F.col(f"{f}.value")) if f == "net_quantity" else F.col(f"{f}.value")
    every = F.array(*(F.col(f) for f in ENTRIES))
    count = lambda status: F.size(F.filter(every, lambda e: e["status"] == status)).cast("long")
    known = {"total_fields": F.size(every).cast("long"), "confirmed": count("CONFIRMED"), "low_confidence": count("LOW_CONFIDENCE"), "missing": count("MISSING"),
             "confidence_sum_milli": F.aggregate(every, F.lit(0).cast("long"), lambda total, e: total + e["confidence_milli"])}
    wide = images.select("image_id", *(c.alias(name) for name, c in known.items()), *(x for f in rules.FIELDS for x in (
        value(f).alias(f"{f}_value"), F.coalesce(f"{f}.raw_text", F.lit("")).alias(f"{f}_raw"),
        ((F.coalesce(value(f), F.lit("")) == "") | (F.col(f"{f}.status") == "MISSING")).alias(f"{f}_missing"))))
    scored = rules.evaluate(rules.marked(wide), ["image_id", *known])
    return scored.select(
        "image_id", *known, "compliance_status", "score_tenths",
        *(F.col(c).cast("long").alias(c) for c in ("critical_violations", "high_violations", "violations_count", "estimated_fee")), "prosecution_recommended")
