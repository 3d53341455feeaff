"""Declarations from text boxes: labels joined with the values around them, ranked by geometry, the first label winning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions import scalars as S

SURE = 400  # thousandths of confidence from which on a field is confirmed
FARTHEST = 12  # line heights between a label and its value
LEAST_HEIGHT = 10  # pixels that a line height counts at least
FEW_BOXES = 200  # up to so many boxes an image is one cell: the pairs are fewer than the copies a grid would make
#: What each relation counts in a candidate's confidence.
MULTIPLIERS = {"SAME_LINE_COMPOSITE": 1.0, "HORIZONTAL_RIGHT": 0.95, "VERTICAL_BELOW": 0.92, "HORIZONTAL_LEFT": 0.85, "VERTICAL_ABOVE": 0.80, "GRID_TABLE_CELL": 0.70, "UNALIGNED_NEIGHBOR": 0.40}


def side(boxes: DataFrame, prefix: str, key: list[str] | None = None) -> DataFrame:
    """Boxes with each column but those of the key (the image alone, if none is given) named for one side of a pair."""
    key = key or ["image_id"]
    return boxes.select(*key, *(F.col(c).alias(f"{prefix}_{c}") for c in boxes.columns if c not in key))


def with_relation(pairs: DataFrame) -> DataFrame:
    """Pairs (l_*, v_*) with relation, norm (distance in line heights), align and proximity."""
    extent = lambda p, a, b: F.greatest(F.lit(1), F.col(f"{p}_{b}") - F.col(f"{p}_{a}"))
    middle = lambda p, a, b: (F.col(f"{p}_{a}") + F.col(f"{p}_{b}")) / 2.0
    pairs = pairs.withColumns({
        "dx": middle("v", "x1", "x2") - middle("l", "x1", "x2"), "dy": middle("v", "y1", "y2") - middle("l", "y1", "y2"),
        "height": F.greatest(F.lit(10.0), (extent("l", "y1", "y2") + extent("v", "y1", "y2")) / 2.0), "reach": F.greatest(extent("l", "x1", "x2"), extent("v", "x1", "x2")) * 1.5})
    dx, dy, height, reach = (F.col(c) for c in ("dx", "dy", "height", "reach"))
    pairs = pairs.withColumn("norm", F.sqrt(dx * dx + dy * dy) / height)
    same, stacked, row = F.col("l_idx") == F.col("v_idx"), (F.abs(dy) > F.abs(dx)) & (F.abs(dy) >= height * 0.5), F.abs(dy) <= height * 1.2
    relation = (F.when(same, "SAME_LINE_COMPOSITE")
                .when(stacked, F.when((dy > 0) & (F.abs(dx) <= reach), "VERTICAL_BELOW").when((dy < 0) & (F.abs(dx) <= reach), "VERTICAL_ABOVE").otherwise("UNALIGNED_NEIGHBOR"))
                .when(row, F.when(dx > 0, "HORIZONTAL_RIGHT").when(dx < 0, "HORIZONTAL_LEFT").otherwise("UNALIGNED_NEIGHBOR"))
                .when(F.col("norm") <= 5.0, "GRID_TABLE_CELL").otherwise("UNALIGNED_NEIGHBOR"))
    pairs = pairs.withColumn("relation", relation)
    off = lambda best, by, of: F.greatest(F.lit(0.2), best - F.abs(by) / of)
    r = F.col("relation")
    align = (F.when(r == "SAME_LINE_COMPOSITE", 1.0).when(r == "VERTICAL_BELOW", off(1.0, dx, reach)).when(r == "VERTICAL_ABOVE", off(0.85, dx, reach))
             .when(r == "HORIZONTAL_RIGHT", off(1.0, dy, height * 1.2)).when(r == "HORIZONTAL_LEFT", off(0.9, dy, height * 1.2)).when(r == "GRID_TABLE_CELL", 0.65).otherwise(0.5))
    return pairs.withColumns({"align": align, "proximity": F.when(same, 1.0).otherwise(F.greatest(F.lit(0.05), F.exp(-F.col("norm") / 4.0)))})


def candidate_milli(pairs: DataFrame) -> Column:
    """A candidate's confidence in thousandths, as a whole number."""
    multiplier = F.lit(0.40)
    for name, m in MULTIPLIERS.items():
        multiplier = F.when(F.col("relation") == name, m).otherwise(multiplier)
    total = 0.35 * F.col("proximity") + 0.30 * F.col("align") + 0.20 * multiplier + 0.15 * F.least(F.lit(1.0), F.col("v_confidence"))
    return F.round(total * 1000).cast("long")


def measured(boxes: DataFrame) -> DataFrame:
    """``boxes`` with how many their image has (``_n``) and its largest line height (``_tall``)."""
    image = Window.partitionBy("image_id")
    return boxes.withColumns({"_n": F.count(F.lit(1)).over(image), "_tall": F.max(F.greatest(F.lit(LEAST_HEIGHT), F.col("y2") - F.col("y1"))).over(image)})


def _cell(prefix: str, low: str, high: str) -> Column:
    """Which cell of the image's grid the middle of a box is in: a cell is as wide as a label can be from its value."""
    at = F.floor((F.col(f"{prefix}_{low}") + F.col(f"{prefix}_{high}")) / 2.0 / (FARTHEST * F.col(f"{prefix}__tall")))
    return F.when(F.col(f"{prefix}__n") > FEW_BOXES, at).otherwise(0)


def in_reach(labels: DataFrame, values: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Pairs (l_*, v_*) of ``measured`` labels and values of one image, and equal in the columns ``also``, that may be near each other.

    No value is farther from its label than FARTHEST times the larger line height, so it is in the label's cell of a grid
    of that width or in one of the eight around it: a label is copied to nine cells, a value is in one. What an image
    makes is in proportion to neighbours, not to the square of its boxes.
    """
    steps = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)))
    stay = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    key = ["image_id", *(also or [])]
    l = side(labels, "l", key).withColumn("_step", F.explode(F.when(F.col("l__n") > FEW_BOXES, steps).otherwise(stay)))
    l = l.withColumns({"_cx": _cell("l", "x1", "x2") + F.col("_step.x"), "_cy": _cell("l", "y1", "y2") + F.col("_step.y")}).drop("_step", "l__n", "l__tall")
    v = side(values, "v", key).withColumns({"_cx": _cell("v", "x1", "x2"), "_cy": _cell("v", "y1", "y2")}).drop("v__n", "v__tall")
    return l.join(v, [*key, "_cx", "_cy"]).where("l_idx <> v_idx").drop("_cx", "_cy")


def candidates(labels: DataFrame, values: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Pairs of a label and another box of its image that has a value, FARTHEST line heights apart at most, with their confidence. Both sides are ``measured``."""
    pairs = with_relation(in_reach(labels, values, also)).where(F.col("norm") <= FARTHEST)
    return pairs.withColumn("milli", candidate_milli(pairs))


def ranked(labels: DataFrame, values: DataFrame) -> DataFrame:
    """Each label's candidates with their rank: by rounded confidence, then by place in the image's list."""
    key = F.struct((-F.col("milli")).alias("a"), F.col("v_idx").alias("b"), F.col("relation").alias("c"))
    per = candidates(labels, values).groupBy("image_id", "l_idx").agg(F.sort_array(F.collect_list(key)).alias("x"))  # boxes of one label: tens
    return per.select("image_id", "l_idx", F.posexplode("x").alias("p", "k")).select(
        "image_id", "l_idx", (F.col("p") + 1).cast("long").alias("rank"), F.col("k.b").alias("v_idx"), F.col("k.c").alias("relation"), (-F.col("k.a")).alias("milli"))


def extract(boxes: DataFrame, kind: str, same_value: Callable[[Column], Column], near_value: Callable[[Column], Column], cap: float, label_ok: Column | None = None,
            fallback: tuple[Column, float, str] | None = None) -> DataFrame:
    """One field of each image: image_id, value, unit, relation, milli, l_idx, v_idx, label (its text), status (confirmed from SURE on).

    Labels go by their place in the list. A label's own line comes before its neighbours, and a label with neither
    leaves the field to the next one. Without any, the first box that ``fallback`` (condition, factor, relation) admits.
    """
    t = F.col("text")
    seen = measured(boxes).withColumns({"own": same_value(t), "near": near_value(t)})
    labels = seen.where(S.found(t, P.LABELS[kind]) & (F.lit(True) if label_ok is None else label_ok))
    thousandths = lambda c: F.round(c * 1000).cast("long")
    pick = lambda order, value, relation, milli, l, v, label: F.struct(*(F.lit(x).cast("long").alias(f"o{i}") if isinstance(x, int) else x.alias(f"o{i}") for i, x in enumerate(order)),
                                                                  value["value"].cast("string").alias("value"), value["unit"].alias("unit"), relation.alias("relation"), milli.alias("milli"), l.alias("l_idx"), v.alias("v_idx"), label.alias("label"))
    idx = F.col("idx").cast("long")
    own = labels.where("own IS NOT NULL").select("image_id", pick((0, idx, 0, 0, idx), F.col("own"), F.lit("SAME_LINE_COMPOSITE"), thousandths(F.least(F.lit(cap), F.col("confidence") * 1.05)), idx, idx, t).alias("x"))
    pairs = candidates(labels.drop("own", "near"), seen.where("near IS NOT NULL").drop("own"))
    l, v = F.col("l_idx").cast("long"), F.col("v_idx").cast("long")
    near = pairs.select("image_id", pick((0, l, 1, -F.col("milli"), v), F.col("v_near"), F.col("relation"), F.col("milli"), l, v, F.col("l_text")).alias("x"))
    every = own.unionByName(near)
    if fallback:
        admits, factor, name = fallback
        rest = seen.where(F.col("near").isNotNull() & admits).select("image_id", pick((1, idx, 0, 0, idx), F.col("near"), F.lit(name), thousandths(F.col("confidence") * factor), F.lit(None).cast("long"), idx, F.lit(None).cast("string")).alias("x"))
        every = every.unionByName(rest)
    return every.groupBy("image_id").agg(F.min("x").alias("x")).select("image_id", *(F.col(f"x.{c}").alias(c) for c in ("value", "unit", "relation", "milli", "l_idx", "v_idx", "label"))).withColumn(
        "status", F.when(F.col("milli") >= SURE, "CONFIRMED").otherwise("LOW_CONFIDENCE"))


def quantity(boxes: DataFrame) -> DataFrame:
    return extract(boxes, "quantity", S.parse_quantity, S.parse_quantity, 0.98, fallback=(~S.has_any(F.col("text"), P.QUANTITY_REJECTS), 0.85, "STANDALONE_QUANTITY_MATCH"))


def mrp(boxes: DataFrame) -> DataFrame:
    return extract(boxes, "mrp", S.parse_mrp, S.parse_mrp, 0.99, fallback=(F.col("text").rlike(P.any_of(["₹", "Rs.", "RS", "INR"])), 0.88, "STANDALONE_CURRENCY_PRICE"))


def _plain(value: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda t: F.when(value(t).isNotNull(), F.struct(value(t).alias("value"), F.lit("code").alias("unit")))


def batch(boxes: DataFrame) -> DataFrame:
    return extract(boxes, "batch", _plain(S.clean_batch), _plain(S.batch_value), 0.96)


def mfg_date(boxes: DataFrame) -> DataFrame:
    """As the others, with ``date_type``: a packing date where the label says so."""
    found = extract(boxes, "mfg_date", S.parse_date, S.parse_date, 0.98, label_ok=~S.has_any(F.col("text"), ["EXP", "BEST BEFORE", "USE BY"]))
    return found.withColumn("date_type", F.when(S.has_any(F.col("label"), ["PKD", "PACKED", "PACKING"]), "packing_date").otherwise("manufacturing_date"))


def expiry(boxes: DataFrame) -> DataFrame:
    """As the others; a month and year counts as an exact date."""
    found = extract(boxes, "expiry", S.parse_date, S.parse_date, 0.96)
    return found.withColumn("unit", F.when(F.col("unit") == "relative_duration", F.col("unit")).otherwise("exact_date"))


def barcode(images: DataFrame, codes: DataFrame) -> DataFrame:
    """Each image's first decoded code (codes: image_id, seq, type, data) as a field; an image without one has it missing."""
    first = codes.groupBy("image_id").agg(F.min(F.struct("seq", "type", "data")).alias("c"))
    seen = F.col("c").isNotNull()
    return images.select("image_id").distinct().join(first, "image_id", "left").select(
        "image_id", F.concat_ws(": ", "c.type", "c.data").alias("text"), seen.alias("seen"), F.col("c.data").alias("raw_text")).select(
        "image_id", F.when(F.col("seen"), F.col("text")).alias("value"), "raw_text", F.when(F.col("seen"), 990).otherwise(0).cast("long").alias("milli"),
        F.when(F.col("seen"), "SCANNED_OPTICAL_CODE").otherwise("NONE").alias("relation"), F.when(F.col("seen"), "CONFIRMED").otherwise("MISSING").alias("status"))


def _first(boxes: DataFrame, holds: Column, *order: str) -> DataFrame:
    """The first box of each image for which ``holds``, by the order given and then the place in the list."""
    key = F.struct(*order, "idx", "text", "x1", "y1", "x2", "y2", "confidence")
    return boxes.where(holds).groupBy("image_id").agg(F.min(key).alias("b")).select("image_id", "b.*")


def _without_label(text: Column, kind: str) -> Column:
    return F.trim(F.replace(F.regexp_replace(text, "(?i)" + P.LABELS[kind], ""), F.lit(":"), F.lit("")))


def manufacturer(boxes: DataFrame) -> DataFrame:
    """The first maker's label with its name, and the address lines stacked below it."""
    label = _first(boxes, S.found(F.col("text"), P.LABELS["manufacturer"]))
    places = boxes.where(S.has_any(F.col("text"), P.PLACES))
    pairs = side(label, "l").join(side(places, "v"), "image_id")
    mid = lambda p, a, b: (F.col(f"{p}_{a}") + F.col(f"{p}_{b}")) / 2.0
    size = lambda p, a, b: F.greatest(F.lit(1), F.col(f"{p}_{b}") - F.col(f"{p}_{a}"))
    down = mid("v", "y1", "y2") - mid("l", "y1", "y2")
    near = pairs.where((F.col("l_idx") != F.col("v_idx")) & (down > 0) & (down <= size("l", "y1", "y2") * 5.0)
                       & (F.abs(mid("v", "x1", "x2") - mid("l", "x1", "x2")) <= F.greatest(size("l", "x1", "x2"), size("v", "x1", "x2")) * 1.5))
    lines = near.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("v_idx", "v_text"))), lambda x: x["v_text"]), ", ").alias("address"))
    name = F.coalesce(F.nullif(_without_label(F.col("text"), "manufacturer"), F.lit("")), F.lit("Manufactured on Package"))
    return label.withColumn("name", name).join(lines, "image_id", "left").select(
        "image_id", "name", F.coalesce("address", "name").alias("address"), F.when(F.col("address").isNotNull(), "CONFIRMED").otherwise("LOW_CONFIDENCE").alias("address_status"))


def product(boxes: DataFrame) -> DataFrame:
    t = F.col("text")
    return _first(boxes, (F.length(t) > 3) & ~S.has_any(t, P.PRODUCT_REJECTS), "y1", "x1").select("image_id", t.alias("product_name"), F.split(F.trim(t), r"\s+").getItem(0).alias("brand_name"))


def care(boxes: DataFrame) -> DataFrame:
    t = F.col("text")
    return _first(boxes, S.found(t, P.LABELS["care"]) | t.rlike(P.any_of(P.CARE_MARKS))).select("image_id", t.alias("consumer_care"), F.col("idx").cast("long").alias("idx"))


def origin(boxes: DataFrame) -> DataFrame:
    """The country on the first origin label, India where the label says none; without a label, India if any box of the image names a place there."""
    t = F.col("text")
    label = _first(boxes, S.found(t, P.LABELS["origin"])).select("image_id", F.coalesce(F.nullif(_without_label(t, "origin"), F.lit("")), F.lit("India")).alias("said"))
    hint = boxes.groupBy("image_id").agg(F.max(S.has_any(t, ["INDIA", "PIN", "DELHI", "BENGALURU", "MUMBAI", "KARNATAKA", "TAMIL NADU", "GUJARAT"])).alias("hint"))
    return hint.join(label, "image_id", "left").select(
        "image_id", F.coalesce("said", F.when(F.col("hint"), "India")).alias("country"),
        F.when(F.col("said").isNotNull(), "SAME_LINE_COMPOSITE").when(F.col("hint"), "INFERRED_FROM_ADDRESS").otherwise("NONE").alias("relation"))


def translated(boxes: DataFrame, translations: DataFrame) -> DataFrame:
    """Boxes with ``is_multilingual`` and ``translated_text``: what ``translations`` (text, translation; a text once) has for it, else the text."""
    said = boxes.join(translations, "text", "left")
    foreign = F.coalesce(S.is_non_english(F.col("text")), F.lit(False))
    return said.select("image_id", F.col("idx").cast("long").alias("idx"), "text", foreign.alias("is_multilingual"), F.when(foreign, F.coalesce("translation", "text")).otherwise(F.col("text")).alias("translated_text"))


def other(boxes: DataFrame) -> DataFrame:
    found = boxes.withColumn("d", S.other_declaration(F.col("text"))).where("d IS NOT NULL")
    return found.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "d"))), lambda x: x["d"]), "; ").alias("declarations"))


def reading_order(boxes: DataFrame, line: int = 25) -> DataFrame:
    """Each box's place when read line by line: lines are ``line`` pixels high."""
    key = F.struct(F.floor(F.col("y1") / line).alias("l"), "x1", "idx", "text")
    per = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(key)).alias("x"))
    return per.select("image_id", F.posexplode("x").alias("place", "b")).select("image_id", F.col("place").cast("long").alias("place"), F.col("b.idx").cast("long").alias("idx"), F.col("b.text").alias("text"))


def transcript(boxes: DataFrame) -> DataFrame:
    return reading_order(boxes).groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("transcript"))
