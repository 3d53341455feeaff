"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


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
