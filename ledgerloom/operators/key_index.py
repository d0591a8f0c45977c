"""Keys of stored rows, by a prefix of their hash, so that a batch reads the parts that its own keys fall in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("prefix", T.IntegerType())])


class KeyIndex:
    """The keys of all rows added, ``<folder>/batch=<number>/prefix=<n>``; each of ``keys`` is the columns of one kind.

    A lookup reads the folders of the prefixes that its own keys have, and joins on the keys themselves. Keys with a null
    column are neither stored nor looked up. A batch that runs again overwrites its folder and looks up the batches before
    it. Batches are merged into one by ``compacted``.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[list[str]], prefixes: int = 256):
        self.spark, self.folder, self.keys, self.prefixes = spark, folder.rstrip("/"), keys, prefixes

    def key(self, columns: list[str]) -> F.Column:
        known = F.least(F.lit(True), *[F.col(c).isNotNull() for c in columns])
        return F.when(known, F.to_json(F.array(*[F.col(c).cast("string") for c in columns])))

    def keyed(self, rows: DataFrame) -> DataFrame:
        """``(kind, key, prefix)`` of all keys of ``rows``, each once."""
        each = F.array(*[F.struct(F.lit(i).alias("kind"), self.key(c).alias("key")) for i, c in enumerate(self.keys)])
        found = rows.select(F.inline(each)).where("key is not null").distinct()
        return found.withColumn("prefix", F.pmod(F.xxhash64("kind", "key"), F.lit(self.prefixes)).cast("int"))

    def stored(self, touched: list[int] | None = None, before: int | None = None) -> DataFrame:
        """Stored keys; only those of the prefixes ``touched`` are read, and of batches before ``before``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], KEYS)
        rows = self.spark.read.schema(KEYS).parquet(self.folder)
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return rows if touched is None else rows.where(F.col("prefix").isin(touched))

    def add(self, rows: DataFrame, batch: int) -> None:
        self.keyed(rows).repartition("prefix").sortWithinPartitions("prefix", "key").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.folder}/batch={batch}")

    def unseen(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """The rows none of whose keys is stored."""
        touched = [r["prefix"] for r in self.keyed(rows).select("prefix").distinct().collect()]  # as many as there are prefixes, at most
        stored = self.stored(touched, before)
        for kind, columns in enumerate(self.keys):
            known = stored.where(F.col("kind") == kind).select(F.col("key").alias("_key")).distinct()
            rows = rows.withColumn("_key", self.key(columns)).join(known, "_key", "left_anti").drop("_key")
        return rows

    def compacted(self, folder: str, until: int) -> KeyIndex:
        """A new index under ``folder`` with the keys of all batches before ``until`` as the one before that."""
        new = KeyIndex(self.spark, folder, self.keys, self.prefixes)
        rows = self.stored(before=until).select("kind", "key", "prefix").distinct()
        rows.repartition("prefix").sortWithinPartitions("prefix", "key").write.mode("overwrite").partitionBy("prefix").parquet(f"{new.folder}/batch={until - 1}")
        return new
