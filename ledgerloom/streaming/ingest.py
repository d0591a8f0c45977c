"""Continuous ingestion: webhook payloads from files or a queue, deduplicated and appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.dedup import owner_keys
from ledgerloom.operators.key_index import KeyIndex
from ledgerloom.sources.webhooks import email_documents, message_images, with_media


def read_payloads(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """A stream of ``(body)`` from text files with a payload in each line."""
    return spark.readStream.schema("value STRING").option("maxFilesPerTrigger", files_at_once).text(path).select(F.col("value").alias("body"))


def received_documents(payloads: DataFrame, media: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All documents of payloads ``(body)``, and the rejected payloads.

    With ``media`` (media_id, content), chat payloads are read too; those whose media are missing are rejected.
    """
    is_chat = F.get_json_object("body", "$.entry").isNotNull() if media is not None else F.lit(False)
    documents, rejected = email_documents(payloads.where(~is_chat))
    if media is not None:
        images, refused = message_images(payloads.where(is_chat))
        met = with_media(images, media)
        documents = documents.unionByName(met.where("error is null").select(*documents.columns))
        lost = met.where("error is not null").select(F.to_json(F.struct("external_id", "media_id", "error")).alias("body"))
        rejected = rejected.unionByName(refused).unionByName(lost, allowMissingColumns=True)
    return documents, rejected


def batch_documents(payloads: DataFrame, owners: tuple[DataFrame, DataFrame] | None = None, media: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents of a batch, the first of each provider id and of each content, and the rejected payloads.

    ``owners`` are the clients' addresses and the ledger: documents of one client have one owner, whichever its sender.
    With ``media`` (media_id, content), chat payloads are read too.
    """
    documents, rejected = received_documents(payloads, media)
    hashed = documents.withColumn("content_hash", F.sha2("content", 256))
    if owners:
        hashed = owner_keys(hashed, *owners)
    else:
        hashed = hashed.withColumn("owner_key", F.concat(F.when(F.col("source") == "EMAIL", "email:").otherwise("phone:"), "sender_identifier"))
    by_id = Window.partitionBy("source", "external_id").orderBy("received_at", "content_hash")
    once = hashed.withColumn("rn", F.row_number().over(by_id)).where("rn = 1").drop("rn")
    by_content = Window.partitionBy("owner_key", "content_hash").orderBy("received_at", "external_id")
    return once.withColumn("rn", F.row_number().over(by_content)).where("rn = 1").drop("rn"), rejected


def start(payloads: DataFrame, documents_path: str, rejected_path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, once: bool = True, owners: tuple[DataFrame, DataFrame] | None = None, media: DataFrame | None = None) -> StreamingQuery:
    """Append each batch's new documents, and its rejected payloads, as parquet; ``then`` gets the new documents.

    A batch has a folder of its own that a repeated run overwrites, so a payload is stored once whatever fails. New is
    what shares neither provider id nor content with stored documents: their keys are stored beside them, by a prefix of
    their hash, and a batch reads the parts its own keys fall in; no state grows in the stream.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        all_found, rejected = batch_documents(batch, owners, media)
        all_found = all_found.persist()
        index = KeyIndex(spark, f"{documents_path.rstrip('/')}-keys", [["source", "external_id"], ["owner_key", "content_hash"]])
        found = index.unseen(all_found, before=number)
        found.write.mode("overwrite").parquet(f"{documents_path}/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        new = spark.read.schema(found.schema).parquet(f"{documents_path}/batch={number}")
        index.add(new, number)
        all_found.unpersist()
        if then:
            then(new, number)

    writer = payloads.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def activity(events: DataFrame, lateness: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Documents received in each window and source, closed when the watermark has passed; later ones are dropped."""
    return events.withWatermark("received_at", lateness).groupBy(F.window("received_at", window), "source").agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Events without those whose provider id came before within the watermark; its state is bounded by it."""
    return events.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["source", "external_id"])
