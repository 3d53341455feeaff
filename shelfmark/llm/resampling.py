"""Target-distribution importance resampling: documents drawn as if by how much likelier their n-grams are in a target.

A position table has a row for each word of each document. For runs of several words, a window over one document's rows
puts the next words beside each word with ``lead``; a run of one needs none, so the words then stay where their text is.
Runs are hashed into buckets, counted in the corpus and in the target, and each bucket's gain, the floored logarithm of
how much commoner it is in the target, is joined back to the runs and added up. Gumbel noise from a digest of the id
turns the weights into a draw without replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.sharding import running
from shelfmark.llm.storage import written
from shelfmark.llm.wordcols import digest_number, words

MILLI = 1000  # gains and scores are in thousandths


def runs(texts: DataFrame, max_order: int, buckets: int, *keys: str) -> DataFrame:
    """Rows (``keys``, _words) to one row a run of 1 to ``max_order`` consecutive words: the keys, ``order`` and ``bucket``.

    The keys must tell the rows apart. A row without words gives one row with nulls, so that no row is lost.
    """
    bucket = lambda run: F.pmod(F.crc32(run), F.lit(buckets)).cast("int")
    if max_order == 1:
        return texts.select(*keys, F.explode_outer("_words").alias("_word")).select(
            *keys, F.when(F.col("_word").isNotNull(), 1).alias("order"), bucket(F.col("_word")).alias("bucket"))
    table = texts.select(*keys, F.posexplode_outer("_words").alias("_pos", "_word"))
    after = Window.partitionBy(*keys).orderBy("_pos")
    table = table.select(*keys, "_word", *(F.lead("_word", j).over(after).alias(f"_next{j}") for j in range(1, max_order)))
    made, run = [F.struct(F.lit(1).alias("order"), F.col("_word").alias("run"))], F.col("_word")
    for j in range(1, max_order):
        run = F.concat(run, F.lit(" "), F.col(f"_next{j}"))  # null beyond the document's end
        made.append(F.struct(F.lit(j + 1).alias("order"), run.alias("run")))
    kept = F.filter(F.array(*made), lambda x: x["run"].isNotNull())
    return table.select(*keys, F.explode_outer(kept).alias("_x")).select(*keys, F.col("_x.order").alias("order"), bucket(F.col("_x.run")).alias("bucket"))


def _counts(texts: DataFrame, text_col: str, max_order: int, buckets: int) -> DataFrame:
    rows = texts.select(F.monotonically_increasing_id().alias("_row"), words(F.col(text_col)).alias("_words"))
    return runs(rows, max_order, buckets, "_row").where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", max_order: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, gain: a row for each of the ``buckets``, written to the shared folder.

    With s of the S runs of ``docs`` in a bucket and t of the T runs of ``target``, its gain is the floor of
    1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))), in doubles. Null and empty texts have no runs.
    """
    spark = docs.sparkSession
    source = _counts(docs, text_col, max_order, buckets).withColumnRenamed("n", "s")
    wanted = _counts(target, target_col, max_order, buckets).withColumnRenamed("n", "t")
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double").alias(c)
    table = every.join(source, "bucket", "left").join(wanted, "bucket", "left").select("bucket", zero("s"), zero("t"))
    whole = Window.partitionBy(F.lit(0))  # as many rows as there are buckets
    table = table.withColumns({"all_s": F.sum("s").over(whole), "all_t": F.sum("t").over(whole)})
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return written(table.select("bucket", F.floor(MILLI * F.ln(ratio)).cast("long").alias("gain")), "gains")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, that the id and the seed alone decide; a null id counts as empty."""
    u = (digest_number(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))) + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-MILLI * F.ln(-F.ln(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, max_order: int = 1, buckets: int = 10_000, seed: int = 2024,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: its id, ``n_features``, ``weight``, ``score`` and ``rank`` (null unless drawn), all long but the id.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred (rounded down) with the highest scores
    are drawn, ties to the smaller id, null ids last; they are ranked from 1. Null and empty texts and texts without
    words have weight 0. Repeated rows count and compete as rows of their own. Texts of any length count whole: the
    sums of a text are made where it is read, and one row a text is shuffled. Other columns are left out, whatever their
    names. Without a target, and without documents, nothing fails: all gains come from the counts that there are.
    """
    spark = docs.sparkSession
    gain = F.broadcast(gains(docs, target, text_col, target_col, max_order, buckets))  # a row a bucket
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_words"))
    per = runs(rows, max_order, buckets, "_row", "_id").join(gain, "bucket", "left").groupBy("_row", "_id").agg(
        F.count("bucket").alias("n_features"), F.count_if(F.col("order") == 1).alias("_n_words"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    scored = written(per.withColumn("score", F.col("weight") + noise(F.col("_id"), seed)), "scores")

    order = [F.desc("score"), F.asc_nulls_last("_id"), F.asc("_row")]
    able = scored.where(F.col("_n_words") >= least_words)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(able.repartitionByRange(n_parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    drawn = percent * ranged.count() // 100
    before = F.broadcast(running(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")), "_part", "n", "_before"))  # a row a partition
    place = ranged.join(before, "_part").withColumn("rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before"))
    columns = [F.col("_id").alias(id_col), "n_features", "weight", "score"]
    ranked = place.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(F.col("_n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
