"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

BATCH_BYTES = 4 << 20  # of rows that go to Python in one batch
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes for ``df`` to have no such column."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands rows to Python about BATCH_BYTES at a time, a longer row alone.

    The bound is set for the session, as a plan reads it when it runs; a bound that the session has already is left. Rows
    are bounded by number alone otherwise, and 10,000 long texts take room in the JVM and in Python at once.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, BATCH_BYTES)
    return df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` below ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves if all tasks run on this machine; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir() + "/shelfmark"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **totals: Column) -> tuple[DataFrame, dict]:
    """``df`` as from ``written``, and aggregates over all its rows, taken as they are written: no job of their own.

    Where Spark finds beforehand that there are no rows, the aggregates may be missing.
    """
    seen = Observation()
    return written(df.observe(seen, *(c.alias(k) for k, c in totals.items())), name), seen.get


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
