"""Several tables written as one: what a batch adds is seen in all of them or in none.

A batch writes its rows of each table to a folder of its own, and is committed by one file in the manifest that names
those folders. Readers read the folders of committed batches alone, so a batch that failed half-way is not there, and
runs again over what it left. A batch that is committed already is never written again. A batch may also stand for
earlier ones of a table (compaction); they are no longer read from the moment its file is there.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> list[dict]:
        """What each committed batch holds, in the order of their names: one small file a batch."""
        folder, fs = self._path(f"{self.root}/_manifest")
        if not fs.exists(folder):
            return []
        files = [s.getPath().toString() for s in fs.listStatus(folder)]
        texts = [r["value"] for r in self.spark.read.text([f for f in files if f.endswith(".json")]).collect()] if any(f.endswith(".json") for f in files) else []
        return sorted((json.loads(t) for t in texts), key=lambda b: b["batch"])

    def committed(self, batch: str) -> bool:
        path, fs = self._path(f"{self.root}/_manifest/{batch}.json")
        return fs.exists(path)

    def _live(self, table: str) -> list[dict]:
        batches = [b for b in self.manifest() if table in b["rows"]]
        gone = {x for b in batches for x in b["replaces"].get(table, [])}
        return [b for b in batches if b["batch"] not in gone]

    def rows(self, table: str) -> int:
        return sum(b["rows"][table] for b in self._live(table))

    def read(self, table: str, empty: DataFrame | None = None) -> DataFrame:
        """All committed rows of a table; ``empty`` if there are none. Never broadcast: columns that repeat make small files of many rows."""
        live = self._live(table)
        if not live and empty is not None:
            return empty.limit(0)
        return self.spark.read.parquet(*(f"{self.root}/{table}/batch={b['batch']}" for b in live)).hint("merge")

    def publish(self, batch: str, tables: dict[str, DataFrame], replaces: dict[str, list[str]] | None = None) -> bool:
        """Writes the tables' rows and commits them together; False, and nothing done, if the batch is committed already."""
        if self.committed(batch):
            return False
        rows = {}
        for table, df in tables.items():
            target = f"{self.root}/{table}/batch={batch}"
            df.write.mode("overwrite").parquet(target)
            rows[table] = self.spark.read.schema(df.schema).parquet(target).count()  # of the files' footers
        entry = json.dumps({"batch": batch, "rows": rows, "replaces": replaces or {}})
        draft, fs = self._path(f"{self.root}/_manifest/_draft-{batch}")
        out = fs.create(draft, True)
        out.write(bytearray(entry.encode()))
        out.close()
        return bool(fs.rename(draft, self._path(f"{self.root}/_manifest/{batch}.json")[0]))  # false if another got there first

    def live(self, table: str) -> list[str]:
        return [b["batch"] for b in self._live(table)]


def numbered(df: DataFrame, order: list[str], name: str, staging: str, first: int = 1) -> DataFrame:
    """``df`` with ``name``: whole numbers from ``first`` without a gap in the order given, which must tell all rows apart.

    Rows are dealt into ranges and written to ``staging`` with their range; each range is counted, and its numbers begin
    where those of the ranges before it end. No task sees more than a range, or one row a range. What is numbered is never
    broadcast, small as its files may be.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).write.mode("overwrite").parquet(staging)
    dealt = spark.read.parquet(staging)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(begins), "_range").withColumn(name, (F.col("_before") + place + (first - 1)).cast("long")).drop("_range", "_before").hint("merge")
