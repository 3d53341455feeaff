"""Queries over several engines' boxes, detectors and image variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import fusion
from shelfmark.sources import labels
from shelfmark.sources.tables import parts

ENGINES = ["alpha", "beta", "gamma"]
VARIANTS = ["original", "deskewed", "contrast", "smooth", "threshold", "sharp", "boosted"]


def engine_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Each box as three engines read it: shifted by some pixels, with other confidences, and now and then misspelt or empty."""
    e = F.explode(F.array(*(F.struct(F.lit(i).alias("n"), F.lit(name).alias("engine")) for i, name in enumerate(ENGINES))))
    b = labels.ocr_boxes(spark, d).withColumn("e", e).withColumn("n", F.col("e.n")).withColumn("k", F.col("image_id") + F.col("idx") * 5 + F.col("n") * 3)
    shift = F.col("k") % 5 - 2
    text = F.when(F.col("k") % 31 == 0, "").when(F.col("k") % 7 == 0, F.replace("text", F.lit("E"), F.lit("3"))).otherwise(F.col("text"))
    return b.select("image_id", F.col("e.engine").alias("engine"), "idx", text.alias("text"), *((F.col(c) + shift).alias(c) for c in ("x1", "y1", "x2", "y2")),
                                         ((50 + F.col("k") * 17 % 50) / 100.0).alias("confidence"))


_BOXES = {"v_engine": """SELECT image_id, engine, idx, CASE WHEN k % 31 = 0 THEN '' WHEN k % 7 = 0 THEN replace(text, 'E', '3') ELSE text END AS text, (50 + k * 17 % 50) / 100.0::DOUBLE AS confidence
    FROM (SELECT *, image_id + idx * 5 + n * 3 AS k FROM v_boxes, (VALUES (0, 'alpha'), (1, 'beta'), (2, 'gamma')) e(n, engine))"""}


def detections(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    boxes = [F.struct(F.lit(m).alias("model"), (k * (i + 3) % 180).alias("x1"), (k * (i + 5) % 220).alias("y1"), (400 + k * (i + 7) % 200).alias("x2"), (380 + k * (i + 11) % 420).alias("y2")) for i, m in enumerate(ENGINES)]
    return parts(spark, d).select(k.alias("image_id"), F.lit(600).alias("width"), F.lit(800).alias("height"), F.explode(F.array(*boxes)).alias("b")).select("image_id", "width", "height", "b.*")


_DETECTIONS = "WITH v_det AS (" + " UNION ALL ".join(f"SELECT p_partkey AS image_id, '{m}' AS model, p_partkey * {i + 3} % 180 AS x1, p_partkey * {i + 5} % 220 AS y1, 400 + p_partkey * {i + 7} % 200 AS x2, 380 + p_partkey * {i + 11} % 420 AS y2 FROM part" for i, m in enumerate(ENGINES)) + ") "


def variants(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = [F.struct(F.lit(i).alias("variant_no"), F.lit(v).alias("variant"), (k * (i + 2) % 10).alias("contrast"), (k * (i + 3) % 8).alias("sharpness"), (k * (i + 5) % 6).alias("edges")) for i, v in enumerate(VARIANTS)]
    return parts(spark, d).select(k.alias("image_id"), F.explode(F.array(*rows)).alias("b")).select("image_id", "b.*")


def _similar(spark: SparkSession, d: str) -> DataFrame:
    b = engine_boxes(spark, d)
    side = lambda e: b.where(F.col("engine") == e).select("image_id", "idx", F.col("text").alias(e))
    return fusion.text_similarity(side("alpha").join(side("beta"), ["image_id", "idx"]), "alpha", "beta")


QUERIES = {
    "q_engine_stats": lambda spark, d: fusion.engine_stats(engine_boxes(spark, d).where("engine <> 'gamma' OR image_id % 10 <> 3"), ENGINES),
    "q_layout_rerank": lambda spark, d: fusion.layout_rerank(engine_boxes(spark, d), "alpha").withColumn("idx", F.col("idx").cast("long")),
    "q_pairwise_iou": lambda spark, d: fusion.pairwise_iou(detections(spark, d)),
    "q_consensus_crop": lambda spark, d: fusion.consensus_crop(detections(spark, d)),
    "q_detector_agreement": lambda spark, d: fusion.agreement(detections(spark, d)),
    "q_ocr_fusion": lambda spark, d: fusion.fused(fusion.clusters(fusion.with_layout(engine_boxes(spark, d), "alpha"))),
    "q_text_similarity": _similar,
    "q_variant_pick": lambda spark, d: fusion.best_variant(variants(spark, d)),
}

_side = lambda lo, hi: f"greatest(0, least(a.{hi}, b.{hi}) - greatest(a.{lo}, b.{lo}))"
_area = lambda t: f"({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1)"
_both = _side("x1", "x2") + " * " + _side("y1", "y2")
ORACLES = {
    "q_engine_stats": labels.with_views("""SELECT image_id, engine, boxes, confidence_sum, CASE WHEN boxes > 0 THEN CAST(round_even(confidence_sum * 10.0::DOUBLE / boxes, 0) AS BIGINT) ELSE 0 END AS mean_milli
        FROM (SELECT i.image_id, e.engine, count(b.idx) AS boxes, coalesce(CAST(sum(CAST(round(b.confidence * 100) AS BIGINT)) AS BIGINT), 0) AS confidence_sum FROM (SELECT DISTINCT image_id FROM v_engine) i
        CROSS JOIN (VALUES ('alpha'), ('beta'), ('gamma')) e(engine) LEFT JOIN v_engine b ON b.image_id = i.image_id AND b.engine = e.engine AND (b.engine <> 'gamma' OR b.image_id % 10 <> 3) GROUP BY 1, 2)""", _BOXES),
    "q_detector_agreement": _DETECTIONS + f"""SELECT image_id, count(*) AS pairs, CAST(round_even(sum(milli) / count(*), 0) AS BIGINT) AS agreement_milli FROM (
        SELECT a.image_id, round_even(round(CASE WHEN {_area('a')} + {_area('b')} - {_both} > 0 THEN CAST({_both} AS DOUBLE) / ({_area('a')} + {_area('b')} - {_both}) ELSE 0 END * 1000000) / 1000, 0) AS milli
        FROM v_det a JOIN v_det b ON a.image_id = b.image_id AND a.model < b.model) GROUP BY 1""",
    "q_layout_rerank": labels.with_views(r"""SELECT image_id, CAST(idx AS BIGINT) AS idx, 'layout' AS engine, CAST(round(least(0.99::DOUBLE, 0.95::DOUBLE * confidence + 0.05::DOUBLE *
        (length(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g')) / (length(text) + 1e-5::DOUBLE))) * 1000) AS BIGINT) AS milli FROM v_engine WHERE engine = 'alpha'""", _BOXES),
    "q_pairwise_iou": _DETECTIONS + f"""SELECT a.image_id, a.model AS a_model, b.model AS b_model, CAST(round(CASE WHEN {_area('a')} + {_area('b')} - {_both} > 0 THEN CAST({_both} AS DOUBLE) / ({_area('a')} + {_area('b')} - {_both}) ELSE 0 END * 1000000) AS BIGINT) AS iou_millionths
        FROM v_det a JOIN v_det b ON a.image_id = b.image_id AND a.model < b.model""",
    "q_consensus_crop": _DETECTIONS + """SELECT image_id, CAST(greatest(0, CASE WHEN ax * 100 <= 7200 THEN 0 ELSE ax END - 12) AS BIGINT) AS x1, CAST(greatest(0, CASE WHEN ay * 100 <= 12000 THEN 0 ELSE ay END - 16) AS BIGINT) AS y1,
        CAST(least(600, CASE WHEN bx * 100 >= 52800 THEN 600 ELSE bx END + 12) AS BIGINT) AS x2, CAST(least(800, CASE WHEN b_y * 100 >= 62400 OR (b_y - ay) * 100 >= 48000 THEN 800 ELSE b_y END + 16) AS BIGINT) AS y2
        FROM (SELECT image_id, min(x1) AS ax, min(y1) AS ay, max(x2) AS bx, max(y2) AS b_y FROM v_det GROUP BY 1)""",
    "q_variant_pick": "SELECT image_id, variant, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, n) AS rn FROM ("
    + " UNION ALL ".join(f"SELECT p_partkey AS image_id, {i} AS n, '{v}' AS variant, (p_partkey * {i + 2} % 10) * 45 + (p_partkey * {i + 3} % 8) * 35 + (p_partkey * {i + 5} % 6) * 20 AS score FROM part" for i, v in enumerate(VARIANTS)) + ")) WHERE rn = 1",
}
