"""Reviewers' decisions as a stream: applied in their order once they can't be overtaken, late ones set apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.review import fold_decisions

DECISIONS = T.StructType([
    T.StructField("match_id", T.LongType()), T.StructField("action", T.StringType()), T.StructField("decided_at", T.TimestampType()), T.StructField("seq", T.LongType())])
STATES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("document_id", T.LongType()), T.StructField("transaction_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])
TABLES = {"log": DECISIONS, "late": DECISIONS, "states": STATES}


class DecisionLog:
    """The decisions taken in, those that came too late, and the match states they led to: a folder for each batch."""

    def __init__(self, spark: SparkSession, folder: str, matches: Callable[[], DataFrame], lateness: str = "1 hour"):
        """``matches`` gives the matches (id, document_id, transaction_id, status) as they were before any decision."""
        self.spark, self.folder, self.matches, self.lateness = spark, folder.rstrip("/"), matches, lateness

    def table(self, name: str, until: int | None = None) -> DataFrame:
        """All rows with their batch, or those of batches before ``until``."""
        schema = T.StructType([*TABLES[name].fields, T.StructField("batch", T.LongType())])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return rows if until is None else rows.where(F.col("batch") < until)

    def save(self, name: str, batch: int, rows: DataFrame) -> None:
        rows.select(*TABLES[name].fieldNames()).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def closed_until(self, batch: int):
        """The time up to which decisions of the batches before ``batch`` can't be overtaken; null where there are none."""
        return self.table("log", batch).agg((F.max("decided_at") - F.expr(f"INTERVAL {self.lateness}")).alias("t")).first()["t"]

    def states(self, until: int | None = None) -> DataFrame:
        """Every match as the last batch that decided about its document left it, with error of the last refused decision."""
        last = Window.partitionBy("id").orderBy(F.desc("batch"))
        new = self.table("states", until).withColumn("_nth", F.row_number().over(last)).where("_nth = 1").select("id", F.col("status").alias("_status"), "error")
        return self.matches().join(new, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")

    def batch(self, rows: DataFrame, number: int) -> None:
        """Take in a batch, and apply what can't be overtaken any more. Running it again writes the same."""
        before = self.closed_until(number)
        late = F.lit(False) if before is None else F.col("decided_at") <= F.lit(before)
        known = rows.select(*DECISIONS.fieldNames()).where("match_id is not null and decided_at is not null")
        self.save("late", number, known.where(late))
        self.save("log", number, known.where(~late))
        now = self.closed_until(number + 1)
        if now is None:
            return
        due = self.table("log", number + 1).where(F.col("decided_at") <= F.lit(now))
        due = (due if before is None else due.where(F.col("decided_at") > F.lit(before))).drop("batch")
        if due.isEmpty():
            return
        # What bears on a decision: its document's matches, and who holds the transactions of these.
        standing = self.states(number)
        documents = standing.join(due.select(F.col("match_id").alias("id")).distinct(), "id", "left_semi").select("document_id").distinct()
        own = standing.join(documents, "document_id", "left_semi")
        others = standing.join(documents, "document_id", "left_anti").join(own.select("transaction_id").distinct(), "transaction_id", "left_semi")
        errors = own.select("id", F.col("error").alias("_error"))
        folded = fold_decisions(own.drop("error").unionByName(others.drop("error")), due)
        self.save("states", number, folded.join(errors, "id").withColumn("error", F.coalesce("error", "_error")))


def start_decisions(decisions: DataFrame, log: DecisionLog, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Fold a stream of decisions (match_id, action, decided_at, seq) into the states of ``log``.

    The states are those of ``fold_decisions`` over all decisions closed so far, in whatever order they came in, as long
    as none came later than the log's lateness behind the newest one; such ones are in its table ``late``.
    """
    writer = decisions.writeStream.foreachBatch(log.batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
