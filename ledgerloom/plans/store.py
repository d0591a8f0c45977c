"""Documents and matches as they are stored: a folder for each batch, read back as they stand now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.schemas import EXTRACTED

#: Who writes: ingestion first, then rematching, which only ever goes over what ingestion left unmatched.
STEPS = ("ingest", "rematch")

_FIELDS = [
    ("doc_id", T.LongType()), ("source", T.StringType()), ("external_id", T.StringType()), ("sender_identifier", T.StringType()), ("owner_key", T.StringType()),
    ("received_at", T.TimestampType()), ("content_hash", T.StringType()), ("fingerprint", T.StringType()), ("extracted", EXTRACTED), ("duplicate_of", T.LongType()),
    ("status", T.StringType()), ("status_reason", T.StringType()), ("error_message", T.StringType()), ("tx_id", T.LongType())]
DOCUMENTS = T.StructType([T.StructField(n, t) for n, t in _FIELDS])
_MATCH = [
    ("document_id", T.LongType()), ("transaction_id", T.LongType()), ("confidence", T.DoubleType()), ("decision_confidence", T.DoubleType()), ("evidence_coverage", T.DoubleType()),
    ("contradictions", T.ArrayType(T.StringType())), ("rank", T.IntegerType()), ("match_status", T.StringType()), ("decided_by", T.StringType()), ("matcher_version", T.StringType())]
MATCHES = T.StructType([T.StructField(n, t) for n, t in _MATCH])
REJECTED = T.StructType([T.StructField("body", T.StringType())])
SCHEMAS = {"documents": DOCUMENTS, "matches": MATCHES, "rejected": REJECTED}


class Store:
    """Tables under one folder, ``<table>/step=<step>/batch=<number>``.

    A batch that runs again overwrites its own folder and reads what was stored before it, so a stream that is restarted
    after a failure stores everything once. Batches of a step have rising numbers.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str, step: str, batch: int) -> str:
        return f"{self.folder}/{table}/step={step}/batch={batch}"

    def save(self, table: str, step: str, batch: int, rows: DataFrame) -> None:
        fields = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields]
        rows.select(*fields).write.mode("overwrite").parquet(self.path(table, step, batch))

    def table(self, table: str, before: tuple[str, int] | None = None) -> DataFrame:
        """All rows, with step and batch; without those of the batch ``before`` and later ones of its step."""
        schema = T.StructType([*SCHEMAS[table].fields, T.StructField("step", T.StringType()), T.StructField("batch", T.LongType())])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")
        return rows.where((F.col("step") != before[0]) | (F.col("batch") < before[1])) if before else rows

    def documents(self, before: tuple[str, int] | None = None) -> DataFrame:
        """Each document as its last batch left it."""
        last = Window.partitionBy("doc_id").orderBy(F.desc("step"), F.desc("batch"))  # rematch comes after ingest
        return self.table("documents", before).withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", "step", "batch")

    def matches(self, before: tuple[str, int] | None = None) -> DataFrame:
        """Stored matches, with the columns that matching reads: document_id, transaction_id, status."""
        return self.table("matches", before).drop("step", "batch").withColumnRenamed("match_status", "status")
