"""Model results that outlast a job, found again by the content they were made from."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ContentStore:
    """A folder of (key, value) entries that many jobs read and add to.

    Entries lie in ``batch=<id>/prefix=<two digits of the key's hash>``. A job writes
    its batch aside and renames it into place, so that others see all of it or
    nothing. Before it computes, a job locks the prefixes of what it misses and looks
    once more: two jobs that miss the same key at a time compute it once. A lock that
    is older than ``lease`` seconds is taken for that of a lost job; if it was not, a
    key is computed twice, which harms nothing.

    A file that cannot be read costs its own keys, which are computed again. So do
    null values, which are not kept.
    """

    def __init__(self, spark: SparkSession, path: str, lease: float = 6 * 3600, pause: float = 0.2, files: int = 1):
        self.spark, self.path, self.lease, self.pause, self.files = spark, path.rstrip("/"), lease, pause, files
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def prefix(self, key: str):
        return F.substring(F.sha1(F.col(key)), 1, 2)

    def entries(self) -> DataFrame:
        """What can be read of ``key, value, batch, prefix``; a key may be in several batches."""
        schema = "key string, value string, batch string, prefix string"
        if not self._batches():
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        return read.parquet(self.path)

    def fill(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "key", value: str = "output") -> DataFrame:
        """``rows`` with ``value`` from the store, and ``computed``: whether this call made it.

        ``compute`` gets one row for each missing key and returns ``key`` and ``value``
        (a string). It is called only if something is missing. Rows with a null key
        have a null value.
        """
        asked = rows.where(F.col(key).isNotNull()).withColumn("_prefix", self.prefix(key))
        batch = uuid.uuid4().hex
        prefixes = sorted(r[0] for r in self._missing(asked, key).select("_prefix").distinct().collect())
        held: list[str] = []
        try:
            for p in prefixes:
                self._lock(p)
                held.append(p)
            # What another job added while this one waited is no longer missing.
            missing = self._missing(asked.where(F.col("_prefix").isin(prefixes)), key).dropDuplicates([key]).drop("_prefix")
            if prefixes and not missing.isEmpty():
                made = compute(missing).select(F.col(key).alias("key"), F.col(value).cast("string").alias("value")).where("value IS NOT NULL")
                self._add(made, batch)
        finally:
            for p in held:
                self._fs.delete(self._at(f"{self.path}/_locks/{p}"), False)
        known = self.entries().groupBy("key").agg(F.min_by(F.struct("value", "batch"), "batch").alias("_e"))
        found = rows.join(known.withColumnRenamed("key", key), key, "left")
        return found.select(*rows.columns, F.col("_e.value").alias(value), F.coalesce(F.col("_e.batch") == batch, F.lit(False)).alias("computed"))

    def compact(self) -> None:
        """Rewrite all batches that are there now as one, with an entry for each key; unreadable files are gone after it."""
        old = self._batches()
        if len(old) < 2:
            return
        now = self.entries().where(F.col("batch").isin([b.split("=", 1)[1] for b in old]))
        self._add(now.groupBy("key").agg(F.min_by("value", "batch").alias("value")), uuid.uuid4().hex)
        for name in old:
            self._fs.delete(self._at(f"{self.path}/{name}"), True)

    def _missing(self, asked: DataFrame, key: str) -> DataFrame:
        good = self.entries().select(F.col("prefix").alias("_prefix"), F.col("key").alias(key)).distinct()
        return asked.join(good, ["_prefix", key], "left_anti")

    def _add(self, made: DataFrame, batch: str) -> None:
        aside = f"{self.path}/_aside/{batch}"
        dealt = made.withColumn("prefix", self.prefix("key")).withColumn("_file", F.pmod(F.xxhash64("key"), F.lit(self.files)))
        dealt.repartition("prefix", "_file").drop("_file").write.partitionBy("prefix").parquet(aside)
        if not self._fs.rename(self._at(aside), self._at(f"{self.path}/batch={batch}")):
            raise OSError(f"could not move {aside} into place")

    def _batches(self) -> list[str]:
        root = self._at(self.path)
        if not self._fs.exists(root):
            return []
        return sorted(n for s in self._fs.listStatus(root) if (n := s.getPath().getName()).startswith("batch="))

    def _lock(self, prefix: str) -> None:
        """Create the prefix's lock file, which fails while there is one."""
        path, gone = self._at(f"{self.path}/_locks/{prefix}"), 0
        while True:
            try:
                self._fs.create(path, False).close()
                return
            except Exception:
                if not self._fs.exists(path):
                    # Freed just now; or it cannot be created at all.
                    gone += 1
                    if gone > 20:
                        raise
                elif time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000 > self.lease:
                    self._fs.delete(path, False)
                else:
                    time.sleep(self.pause)
