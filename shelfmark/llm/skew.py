"""Joins on keys that a large share of all rows may have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_HOT = 1000  # rows of one key that are never too many for a task
HOT_KEYS = 4  # hot keys a shuffle partition, at most


def most_rows(rows: DataFrame, total: int) -> int:
    """How many of ``total`` rows one key may have before it is hot."""
    return max(LEAST_HOT, total // (HOT_KEYS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def join_counted(rows: DataFrame, side: DataFrame, keys: list[str], n: str, known: tuple[int, int] | None = None) -> DataFrame:
    """``rows`` joined with ``side``, which has one row a key and in ``n`` how many of ``rows`` have the key (or a bound); ``n`` is dropped.

    ``known`` is the sum of ``n`` and the largest, where the caller has them; else a job asks for them.

    A key that holds more than its share of a shuffle partition is hot. There can be no more of those than HOT_KEYS a
    partition, so they are broadcast, and their rows stay where they are; all others are joined as usual. Both tables
    are read more than once and should be written ones. Null keys join with nothing.
    """
    total, most = known or side.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    limit = most_rows(rows, total)
    if most <= limit:
        return rows.join(side.drop(n), keys)
    hot = side.where(F.col(n) > limit)
    cold = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(side.where(F.col(n) <= limit).drop(n), keys)
    return rows.join(F.broadcast(hot.drop(n)), keys).unionByName(cold)
