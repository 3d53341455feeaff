"""Sharding by a two-pass external shuffle.

Pass one scatters the records into buckets by a seeded hash; there are as many buckets as it takes for one to fit in a
task's memory. Pass two runs a seeded Fisher-Yates shuffle inside each bucket and writes it. The buckets one after the
other are a random order of all records; shards are equal cuts of that order, so the shard law is ``rows``: the row
counts of two shards differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.storage import free, shared_path, written

BUCKET_BYTES = 16 << 20  # of text in one bucket, on average
ROW_BYTES = 64  # what a row takes besides its text
REPEATED_BYTES = 1 << 20  # rows of one id and text that take more are dealt out row by row
STRIDE = 4096  # buckets whose counts are added up in one task


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniformly random order of 0..n-1 that ``seed`` alone decides."""
    order = np.arange(n)
    draws = np.random.default_rng(seed).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def _scattered(docs: DataFrame, key: str, salt: str, size: str, id_col: str, text_col: str, seed: int) -> DataFrame:
    """``docs`` with the hash of id and text, and a salt that is 0 but for rows of which there is more than a task should hold.

    The salt of those is their number in a table written beforehand, so that every later read of a row finds the same.
    """
    keyed = docs.withColumns({key: F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)),
                              size: (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).cast("long")})
    hot = written(keyed.groupBy(key).agg(F.sum(size).alias(size)).where(F.col(size) > REPEATED_BYTES).select(key), "repeated")
    if hot.isEmpty():
        return keyed.withColumn(salt, F.lit(0).cast("long"))
    repeats = keyed.join(hot, key, "left_semi").withColumn(salt, F.monotonically_increasing_id())
    columns = [*docs.columns, key, size, salt]
    return keyed.join(hot, key, "left_anti").withColumn(salt, F.lit(0).cast("long")).select(columns).unionByName(written(repeats.select(columns), "repeats"))


def running(counts: DataFrame, bucket: str, n: str, before: str) -> DataFrame:
    """One row a bucket with the number of rows in all buckets before it; two steps, so that no task holds all buckets."""
    group, up = "_group", "_up"
    inside = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(group, F.floor(F.col(bucket) / STRIDE))
    groups = counts.groupBy(group).agg(F.sum(n).alias(up)).select(group, F.coalesce(F.sum(up).over(over), F.lit(0)).alias(up))
    return counts.join(groups, group).select(bucket, (F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(up)).cast("long").alias(before))


def external_shuffle(docs: DataFrame, n_shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
                     bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes all rows of ``docs`` as ``n_shards`` folders of Parquet in shuffled order and reads them back.

    Returns the columns of ``docs`` plus ``shard`` and ``slot`` (the place in the shard, gapless from 0); columns of
    these names in ``docs`` are replaced. The order depends on the rows, ``seed`` and the number of buckets alone:
    inside a bucket, rows are sorted by id and text before the shuffle, so a task that runs again gives the same rows.
    Null ids and texts, equal rows and texts of any length are rows like any other (repeats of a row are told apart by
    nothing and may stand in either's place; more of them than REPEATED_BYTES are dealt over all buckets); an empty
    table gives no rows. There are at least as many buckets as shuffle partitions.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    columns = list(docs.columns)
    key, salt, size, bucket, n, before = free(docs, "_key", "_salt", "_size", "_bucket", "_n", "_before")
    scattered = _scattered(docs, key, salt, size, id_col, text_col, seed)
    total, n_rows = scattered.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    n_buckets = int(max(1, -(-total // bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    scattered = scattered.withColumn(bucket, F.pmod(F.xxhash64(key, salt), F.lit(n_buckets)).cast("int")).drop(salt, size)
    starts = running(scattered.groupBy(F.col(bucket).alias("at")).agg(F.count(F.lit(1)).alias(n)), "at", n, before)
    each, extra = divmod(n_rows, n_shards)

    def shuffle_bucket(rows: pa.Table, start: pa.Table) -> pa.Table:
        first, number = start[before][0].as_py(), start["at"][0].as_py()
        rows = rows.sort_by([(key, "ascending"), (id_col, "ascending"), (text_col, "ascending")])
        rows = rows.take(pa.array(fisher_yates(len(rows), seed * 1_000_003 + number)))
        place = first + np.arange(len(rows), dtype=np.int64)
        shard = np.where(place < extra * (each + 1), place // (each + 1), extra + (place - extra * (each + 1)) // max(each, 1))
        slot = place - shard * each - np.minimum(shard, extra)
        return rows.select(columns).append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))

    schema = docs.withColumns({"shard": F.lit(0).cast("int"), "slot": F.lit(0).cast("long")}).schema
    path = shared_path(spark, "shards")
    shuffled = scattered.repartition(n_buckets, bucket).groupBy(bucket).cogroup(starts.groupBy("at")).applyInArrow(shuffle_bucket, schema)
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path).select(*columns, "shard", "slot")


def shard_digest(shards: DataFrame) -> DataFrame:
    """What the shards hold, one row a record: size and checksum of its text, and where it stands."""
    text = F.coalesce("text", F.lit(""))
    return shards.select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
