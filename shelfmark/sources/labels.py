"""Adapter views: label lines, text boxes and field tables, made from ``part`` by its key.

Lines and boxes are built from small literal tables of texts and places, chosen by the key's remainders, so that every
defect and every layout occurs. The same tables are written out as SQL for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.tables import parts

#: line: (label, value) by remainder; # stands for the price or code made from the key. A line whose label is None is left out.
LINES: dict[str, list[tuple[str | None, str]]] = {
    "quantity": [("NET QTY:", "500 g"), ("NET WT", "250 GMS"), ("Net Volume:", "1.5 Litres"), ("CONTENTS", "12 Pouches"), ("NET", "20 x 15 cm"), ("Net Weight:", "2 kilos"), (None, "")],
    "mrp": [("MRP", "Rs. #.50 (Incl. of all taxes)"), ("M.R.P.", "₹ #,25 inclusive of all taxes"), ("PRICE", "$ 5"), ("MRP (Incl. taxes)", "Rs #"), (None, "")],
    "batch": [("BATCH NO:", "B#"), ("LOT NO.", "L-#A"), ("BATCH", "DATE"), (None, "")],
    "mfg_date": [("MFG DATE:", "08/2026"), ("PKD", "15-08-2026"), ("MFD", "AUG 26"), ("PACKED ON", "2026.08.15"), (None, "")],
    "expiry": [("BEST BEFORE", "24 MONTHS FROM PACKING"), ("EXP DATE:", "08/12/2028"), ("USE BY", "JAN-27"), (None, "")],
    "manufacturer": [("MFD BY:", "Maker #"), ("MARKETED BY", "Seller #"), ("PACKED BY:", ""), (None, "")],
    "address": [("Plot #, Industrial Estate, Pune", ""), ("Main Road, Delhi", ""), ("somewhere", "")],
    "care": [("CONSUMER CARE:", "1800-123-4567 care@shop.example"), ("TOLL FREE", "1800 425 998"), ("write to help@shop.example", ""), (None, "")],
    "origin": [("COUNTRY OF ORIGIN:", "INDIA"), ("MADE IN", "NEPAL"), (None, ""), (None, "")],
    "other": [("FSSAI LIC NO 100#", ""), ("INGREDIENTS: wheat, salt", ""), ("STORE IN COOL AND DRY PLACE", ""), ("100% VEGETARIAN", ""), (None, "")],
}
#: where the value's box stands from the label's, by remainder: together, right, left, below, above, in the grid, far.
PLACES = [None, (150, 0), (-130, 0), (0, 34), (0, -34), (120, 70), (2000, 900)]


def _choose(rows: list, pick, key: Column, step: int) -> Column:
    return F.element_at(F.array(*(F.lit(pick(r)).cast("string") for r in rows)), (key * step % len(rows) + 1).cast("int"))


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, line (number), kind, label, value, text: up to ten declarations and the product's name for each part."""
    key = F.col("p_partkey")
    code = F.lpad((key % 900 + 10).cast("string"), 3, "1")
    lines = [F.struct(F.lit(0).alias("line"), F.lit("product").alias("kind"), F.upper("p_name").alias("label"), F.lit("").alias("value"))]
    for n, (kind, rows) in enumerate(LINES.items(), 1):
        fill = lambda c: F.replace(c, F.lit("#"), code)
        lines.append(F.struct(F.lit(n).alias("line"), F.lit(kind).alias("kind"), fill(_choose(rows, lambda r: r[0], key, 1)).alias("label"), fill(_choose(rows, lambda r: r[1], key, 1)).alias("value")))
    out = parts(spark, sf_dir).select(key.alias("image_id"), F.explode(F.array(*lines)).alias("x")).select("image_id", "x.*").where("label IS NOT NULL")
    return out.withColumn("text", F.trim(F.concat_ws(" ", "label", "value")))


def ocr_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, idx, text, x1, y1, x2, y2, confidence: each line as one box or as a box for the label and one for its value."""
    lines = label_lines(spark, sf_dir)
    layout = (F.col("image_id") + F.col("line")) % len(PLACES)
    whole = (layout == 0) | (F.col("value") == "") | F.col("kind").isin("manufacturer", "care", "origin")
    x, y = F.lit(40), 60 + F.col("line") * 90

    def box(order: int, text: Column, dx: Column, dy: Column) -> Column:
        return F.struct((F.col("line") * 2 + order).alias("idx"), text.alias("text"), (x + dx).cast("long").alias("x1"), (y + dy).cast("long").alias("y1"),
                        (x + dx + 8 * F.length(text)).cast("long").alias("x2"), (y + dy + 24 + F.col("image_id") % 5).cast("long").alias("y2"))

    shift = lambda i: F.element_at(F.array(*(F.lit(p[i] if p else 0) for p in PLACES)), (layout + 1).cast("int"))
    zero = F.lit(0)
    boxes = F.when(whole, F.array(box(0, F.col("text"), zero, zero))).otherwise(F.array(box(0, F.col("label"), zero, zero), box(1, F.col("value"), shift(0), shift(1))))
    out = lines.select("image_id", F.explode(boxes).alias("b")).select("image_id", "b.*")
    return out.withColumn("confidence", (55 + (F.col("image_id") * 7 + F.col("idx") * 3) % 43) / 100.0)


def _sql_choose(rows: list, i: int) -> str:
    said = ", ".join("NULL" if r[i] is None else "'" + r[i].replace("'", "''") + "'" for r in rows)
    return f"replace(([{said}])[CAST(p_partkey % {len(rows)} + 1 AS INTEGER)], '#', lpad(CAST(p_partkey % 900 + 10 AS VARCHAR), 3, '1'))"


_PARTS = " UNION ALL ".join(f"SELECT p_partkey AS image_id, {n} AS line, '{kind}' AS kind, {_sql_choose(rows, 0)} AS label, {_sql_choose(rows, 1)} AS value FROM part"
                            for n, (kind, rows) in enumerate(LINES.items(), 1))
_SHIFT = [", ".join(str(p[i] if p else 0) for p in PLACES) for i in (0, 1)]
VIEW_SQL = {
    "v_lines": f"""SELECT *, trim(label || ' ' || value) AS text FROM (SELECT p_partkey AS image_id, 0 AS line, 'product' AS kind,
        upper(p_name) AS label, '' AS value FROM part UNION ALL {_PARTS}) WHERE label IS NOT NULL""",
    "v_boxes": f"""SELECT image_id, line * 2 + o AS idx, t AS text, CAST(40 + dx AS BIGINT) AS x1, CAST(60 + line * 90 + dy AS BIGINT) AS y1,
        CAST(40 + dx + 8 * length(t) AS BIGINT) AS x2, CAST(60 + line * 90 + dy + 24 + image_id % 5 AS BIGINT) AS y2, (55 + (image_id * 7 + (line * 2 + o) * 3) % 43) / 100.0::DOUBLE AS confidence
        FROM (SELECT image_id, line, 0 AS o, CASE WHEN whole THEN text ELSE label END AS t, 0 AS dx, 0 AS dy FROM v_laid UNION ALL
        SELECT image_id, line, 1, value, ([{_SHIFT[0]}])[CAST(layout + 1 AS INTEGER)], ([{_SHIFT[1]}])[CAST(layout + 1 AS INTEGER)] FROM v_laid WHERE NOT whole)""",
}
_LAID = f"""SELECT *, (image_id + line) % {len(PLACES)} AS layout, (image_id + line) % {len(PLACES)} = 0 OR value = '' OR kind IN ('manufacturer', 'care', 'origin') AS whole FROM v_lines"""


def with_views(sql: str, more: dict[str, str] | None = None) -> str:
    """``sql`` with the label views, and ``more`` ones that read them, in front."""
    parts = {"v_lines": VIEW_SQL["v_lines"], "v_laid": _LAID, "v_boxes": VIEW_SQL["v_boxes"]} | (more or {})
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in parts.items()) + " " + sql
