"""Fusing the boxes of several engines: greedy clusters, representatives, detector consensus and best variants."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import scalars as S

CLUSTER_COLUMNS = ["image_id", "engine", "idx", "text", "x1", "y1", "x2", "y2", "confidence"]
READABLE_SIGNS = "₹/.,:;@%()[]&-"


def iou(a: tuple, b: tuple) -> float:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where the union is empty."""
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, wide) * max(0, high)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def iou_column(a: str, b: str) -> Column:
    """``iou`` of two boxes whose columns have these prefixes."""
    at = lambda p, c: F.col(f"{p}_{c}")
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(at(a, hi), at(b, hi)) - F.greatest(at(a, lo), at(b, lo)))
    both = side("x1", "x2") * side("y1", "y2")
    area = lambda p: (at(p, "x2") - at(p, "x1")) * (at(p, "y2") - at(p, "y1"))
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of two texts without regard to case."""
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


@lru_cache(maxsize=1 << 16)
def alike(a: str, b: str, least: float) -> bool:
    """Whether the similarity of two lower-cased texts is above ``least``; bounds on it are tried first. Labels repeat, so answers are kept for a while."""
    if a == b:
        return least < 1
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() > least and m.quick_ratio() > least and m.ratio() > least


def _neighbours(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j), i before j, of boxes of one image that overlap so far that they are one, or are if their texts are alike; and whether they are one as it is.

    ``table`` is sorted by image, top and left, and ``starts`` is where each image begins. A sweep down the image: those that
    share some height with a box begin above its bottom, so they are one stretch after it, found by a binary search.
    """
    x1, y1, x2, y2 = (table[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
    image = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(table))))
    low, high = min(y1.min(), y2.min()), max(y1.max(), y2.max())
    line = image * (high - low + 1)  # images one below the other
    place = np.arange(len(table))
    count = np.maximum(np.searchsorted(y1 - low + line, y2 - low + line, "left") - place - 1, 0)
    i = np.repeat(place, count)
    j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + i + 1
    wide, tall = np.minimum(x2[i], x2[j]) - np.maximum(x1[i], x1[j]), np.maximum(0, np.minimum(y2[i], y2[j]) - np.maximum(y1[i], y1[j]))
    both, area = np.maximum(0, wide) * tall, (x2 - x1) * (y2 - y1)
    union = area[i] + area[j] - both
    one = np.where(union > 0, both / np.where(union > 0, union, 1), 0) > 0.35
    near = one | (tall / (np.minimum(y2[i] - y1[i], y2[j] - y1[j]) + 1e-5) > 0.65)
    return i[near], j[near], one[near]


def _clustered(table: pa.Table) -> pa.Table:
    """Whole images' boxes, sorted, with cluster and place. Greedy: the first box not yet taken takes all boxes not yet taken that match it."""
    ids = table["image_id"].combine_chunks()
    starts = np.concatenate([[0], pc.run_end_encode(ids).run_ends.to_numpy()[:-1]]).astype(np.int64)
    texts = [(t or "").lower() for t in table["text"].to_pylist()]
    taken = np.full(len(table), -1).tolist()
    for i, j, one in zip(*(x.tolist() for x in _neighbours(table, starts)), strict=True):
        if taken[i] < 0:
            taken[i] = i
        if taken[i] == i and taken[j] < 0 and (one or alike(texts[i], texts[j], 0.4)):
            taken[j] = i
    place = np.arange(len(table))
    begin = np.repeat(starts, np.diff(np.append(starts, len(table))))
    cluster = np.where(np.array(taken) < 0, place, taken) - begin
    return table.append_column("cluster", pa.array(cluster)).append_column("place", pa.array(place - begin))


def clusters(boxes: DataFrame) -> DataFrame:
    """Boxes with the cluster they are in (the place of its first box in their image) and their place, from top to bottom and left to right.

    The order decides who takes whom. Images are sorted together and cut out of the stream of batches, many at a time; an
    image that goes on in the next batch waits for it.
    """
    schema = boxes.select(CLUSTER_COLUMNS).withColumns({"cluster": F.lit(0).cast("long"), "place": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            ends = pc.run_end_encode(table["image_id"].combine_chunks()).run_ends.to_numpy()
            cut = int(ends[-2]) if len(ends) > 1 else 0
            held = table.slice(cut)
            if cut:
                yield from _clustered(table.slice(0, cut).combine_chunks()).to_batches()
        if held is not None:
            yield from _clustered(held.combine_chunks()).to_batches()

    return boxes.select(CLUSTER_COLUMNS).repartition("image_id").sortWithinPartitions("image_id", "y1", "x1", "engine", "idx").mapInArrow(run, schema)


def readable_share(text: Column) -> Column:
    """The share of letters, digits, white space and signs that labels use; 0 of an empty text."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s₹/.,:;@%()\[\]&-]", ""))
    return F.when(F.length(text) > 0, kept / F.length(text)).otherwise(F.lit(0.0))


def with_layout(boxes: DataFrame, primary: str) -> DataFrame:
    """Boxes of all engines and, as those of one more, the layout engine's (see ``layout_rerank``)."""
    again = layout_rerank(boxes, primary).select("image_id", "idx", "engine", (F.col("milli") / 1000).alias("confidence"))
    own = boxes.where(F.col("engine") == primary).drop("engine", "confidence")
    return boxes.unionByName(own.join(again, ["image_id", "idx"]).select(boxes.columns))


def fused(clustered: DataFrame, line: int = 25) -> DataFrame:
    """One row a cluster: its best text with confidence and engine, envelope, engines, number of boxes, and place in the reading order; clusters without any text are left out."""
    size = clustered.groupBy("image_id", "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")).hint("merge")  # a row a cluster: never to be broadcast
    with_text = clustered.where(F.length("text") > 0).join(size.select("image_id", "cluster", "n"), ["image_id", "cluster"])
    score = 0.7 * F.col("confidence") + 0.2 * readable_share(F.col("text")) + F.least(F.lit(0.3), 0.15 * (F.col("n") - 1))
    best = with_text.groupBy("image_id", "cluster").agg(F.min(F.struct((-score).alias("s"), "place", "text", "confidence", "engine")).alias("b"))
    rows = best.join(size, ["image_id", "cluster"]).select(
        "image_id", "cluster", F.col("b.text").alias("text"), F.round(F.least(F.lit(1.0), F.col("b.confidence")), 4).alias("confidence"), "x1", "y1", "x2", "y2",
        F.col("b.engine").alias("source_model"), "engines", F.col("n").alias("agreement"))
    order = Window.partitionBy("image_id").orderBy(F.floor(F.col("y1") / line), "x1", "cluster")
    return rows.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def text_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the similarity of two text columns; nulls count as empty."""
    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([similarity(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="float64")

    return pairs.withColumn("similarity", ratio(F.col(a), F.col(b)))


def engine_stats(boxes: DataFrame, engines: list[str]) -> DataFrame:
    """Each image's boxes, and the mean of their confidence in thousandths, for each of ``engines``: 0 where it has none."""
    n, total = F.count("engine"), F.sum(F.round(F.col("confidence") * 100).cast("long"))
    every = boxes.select("image_id").distinct().withColumn("engine", F.explode(F.array(*map(F.lit, engines))))
    found = boxes.groupBy("image_id", "engine").agg(n.alias("boxes"), total.alias("confidence_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = every.join(found, ["image_id", "engine"], "left").withColumns({c: zero(F.col(c)) for c in ("boxes", "confidence_sum")})
    return rows.withColumn("mean_milli", S.mean_milli(F.col("confidence_sum"), F.col("boxes")))


def layout_rerank(boxes: DataFrame, primary: str) -> DataFrame:
    """The primary engine's boxes once more, as a layout engine's, with their confidence drawn to the share of letters and digits."""
    share = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}\s]", "")) / (F.length("text") + 1e-5)
    return boxes.where(F.col("engine") == primary).select("image_id", "idx", F.lit("layout").alias("engine"), F.round(F.least(F.lit(0.99), 0.95 * F.col("confidence") + 0.05 * share) * 1000).cast("long").alias("milli"))


def pairwise_iou(detections: DataFrame) -> DataFrame:
    """IoU of each pair of detectors on each image, in millionths."""
    side = lambda p: detections.select("image_id", F.col("model").alias(f"{p}_model"), *(F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")))
    return side("a").join(side("b"), "image_id").where("a_model < b_model").select(
        "image_id", "a_model", "b_model", F.round(iou_column("a", "b") * 1_000_000).cast("long").alias("iou_millionths"))


def agreement(detections: DataFrame) -> DataFrame:
    """Each image's mean over the pairs of detectors of the IoU, pairs and mean each in thousandths, half to even."""
    milli = F.bround(F.col("iou_millionths") / 1000).cast("long")
    per = pairwise_iou(detections).groupBy("image_id").agg(F.sum(milli).alias("s"), F.count(F.lit(1)).alias("pairs"))
    return per.select("image_id", "pairs", F.bround(F.col("s") / F.col("pairs")).cast("long").alias("agreement_milli"))


def consensus_crop(detections: DataFrame) -> DataFrame:
    """The envelope of all detectors, drawn to near edges, with 2 % of the image around it: image_id, x1, y1, x2, y2.

    ``detections`` has width and height of the image. Fixed values: bottom to the edge from 78 % of the height on or for
    crops of 60 % of the height; top within 15 %, left within 12 %, right from 88 % on.
    """
    e = detections.groupBy("image_id").agg(F.min("x1").alias("ax"), F.min("y1").alias("ay"), F.max("x2").alias("bx"), F.max("y2").alias("by"), F.max("width").alias("w"), F.max("height").alias("h"))
    c, w, h = F.col, F.col("w"), F.col("h")
    snapped = e.select("image_id", "w", "h", F.when(c("ax") * 100 <= w * 12, 0).otherwise(c("ax")).alias("ax"), F.when(c("ay") * 100 <= h * 15, 0).otherwise(c("ay")).alias("ay"),
                       F.when(c("bx") * 100 >= w * 88, w).otherwise(c("bx")).alias("bx"), F.when((c("by") * 100 >= h * 78) | ((c("by") - c("ay")) * 100 >= h * 60), h).otherwise(c("by")).alias("by"))
    pad_x, pad_y = F.floor(w * 2 / 100), F.floor(h * 2 / 100)
    return snapped.select("image_id", F.greatest(F.lit(0), c("ax") - pad_x).cast("long").alias("x1"), F.greatest(F.lit(0), c("ay") - pad_y).cast("long").alias("y1"),
                          F.least(w, c("bx") + pad_x).cast("long").alias("x2"), F.least(h, c("by") + pad_y).cast("long").alias("y2"))


def best_variant(metrics: DataFrame) -> DataFrame:
    """Each image's variant with the largest weighted score (contrast 45, sharpness 35, edges 20); of equal ones the first."""
    score = F.col("contrast") * 45 + F.col("sharpness") * 35 + F.col("edges") * 20
    best = metrics.groupBy("image_id").agg(F.min(F.struct((-score).alias("s"), "variant_no", "variant")).alias("b"))
    return best.select("image_id", F.col("b.variant").alias("variant"), (-F.col("b.s")).cast("long").alias("score"))
