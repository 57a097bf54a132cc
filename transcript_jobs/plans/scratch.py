"""Tables that cut lineage between the steps of an iterative job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; in local mode without one, a new temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Writes intermediate results as Parquet in the shared folder and reads them back.

    A table written this way survives the loss of executors and has no lineage.
    ``drop`` removes one that no later step reads, ``close`` all of them; what a
    returned DataFrame still reads stays until its user closes it or clears the
    session's scratch folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._kept: set[str] = set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self._kept.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in self._kept.intersection(names):
            self._delete(f"{self.root}/{name}")
            self._kept.discard(name)

    def close(self) -> None:
        """Remove all tables and the folder."""
        self._delete(self.root)
        self._kept.clear()

    def _delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
