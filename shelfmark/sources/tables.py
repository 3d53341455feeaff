"""The driver's parquet tables, read by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Rows of ``part`` that a task takes at most: each is exploded into some ten lines and more boxes.
PARTS_A_TASK = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` dealt by its key into partitions of a bounded number of rows, and marked as too large to be broadcast.

    The file is small for what is made of it: read as it is, it is one task's, and what that task explodes and sorts
    grows with the table. What is made of the parts stays dealt by image. Spark takes the size of exploded rows for that of
    the rows before, and would gather millions of them on the driver to broadcast them; the hint goes with the rows
    through all steps up to a join. The rows are counted from the file's footer.
    """
    rows = table(spark, sf_dir, "part")
    n = max(spark.sparkContext.defaultParallelism, -(-rows.count() // PARTS_A_TASK))
    return rows.repartition(n, "p_partkey").hint("merge")
