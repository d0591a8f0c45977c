"""Incoming messages as tables: signatures, payload checks, attachments and images, media and extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import lenient_base64, normalize_phone
from ledgerloom.sources.schemas import EMAIL_PAYLOAD, EXTRACTED, MESSAGE_PAYLOAD


#: The last second that payloads' dates can name.
LAST_SECOND = 8_640_000_000_000


def hmac_sha256(body: Column, secret: str) -> Column:
    """Hex HMAC of a text or binary column; the key's pads are made once, the hashing stays in the JVM."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytearray(b ^ 0x36 for b in key), bytearray(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), body.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def verified_signature(rows: DataFrame, body: str, header: str, secret: str | None) -> DataFrame:
    """``rows`` with signature: OK, NOT_ENFORCED (no secret), MISSING, MALFORMED or MISMATCH; only the first two pass."""
    if not secret:
        return rows.withColumn("signature", F.lit("NOT_ENFORCED"))
    given = F.lower(F.regexp_replace(F.trim(F.col(header)), "^sha256=", ""))
    return rows.withColumn("signature", F.when(F.coalesce(F.trim(F.col(header)), F.lit("")) == "", "MISSING").when(
        ~given.rlike("^[0-9a-f]{64}$"), "MALFORMED").when(given == hmac_sha256(F.col(body), secret), "OK").otherwise("MISMATCH"))


def _filled(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def _email(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False))


def _epoch(c: Column) -> Column:
    """Whether a text is a number of seconds that a date can hold."""
    return F.coalesce(c.rlike("^[0-9]+$") & (c.try_cast("long") <= LAST_SECOND), F.lit(False))


def email_documents(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Valid and rejected mails: valid ones as a document for each attachment, rejected ones as they came.

    The sender is in lower case. A mail's only attachment has the mail's id, several have it with their place.
    """
    parsed = raw.withColumn("p", F.from_json(body, EMAIL_PAYLOAD))
    p = F.col("p")
    valid = F.coalesce(
        _filled(p["messageId"]) & _email(p["from"]) & _email(p["to"]) & p["subject"].isNotNull() & F.try_to_timestamp(p["receivedAt"]).isNotNull()
        & (F.size(p["attachments"]) > 0) & F.forall(p["attachments"], lambda a: _filled(a["filename"]) & _filled(a["contentType"]) & _filled(a["contentBase64"])), F.lit(False))
    each = parsed.where(valid).select("p", F.posexplode("p.attachments").alias("place", "a"))
    documents = each.select(
        F.lit("EMAIL").alias("source"),
        F.when(F.size("p.attachments") == 1, F.col("p.messageId")).otherwise(F.concat("p.messageId", F.lit("::"), "place")).alias("external_id"),
        F.lower("p.from").alias("sender_identifier"), F.try_to_timestamp("p.receivedAt").alias("received_at"),
        lenient_base64("a.contentBase64").alias("content"), F.col("a.contentType").alias("mime_type"))
    return documents, parsed.where(~valid).drop("p")


def message_images(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Valid and rejected chat payloads: valid ones as a row for each image, with its media id, still without content."""
    parsed = raw.withColumn("p", F.from_json(body, MESSAGE_PAYLOAD))
    nested = F.flatten(F.flatten(F.transform("p.entry", lambda e: F.transform(e["changes"], lambda c: c["value"]["messages"]))))
    listed = parsed.withColumn("m", nested)
    valid = F.coalesce(
        (F.size("m") > 0) & F.forall("m", lambda m: _filled(m["id"]) & _filled(m["from"]) & _epoch(m["timestamp"]) & (m["type"] == "image") & _filled(m["image"]["id"]) & _filled(m["image"]["mime_type"])), F.lit(False))
    each = listed.where(valid).select(F.explode("m").alias("m"))
    images = each.select(
        F.lit("WHATSAPP").alias("source"), F.col("m.id").alias("external_id"), normalize_phone("m.from").alias("sender_identifier"),
        F.timestamp_seconds(F.col("m.timestamp").try_cast("long")).alias("received_at"), F.col("m.image.id").alias("media_id"), F.col("m.image.mime_type").alias("mime_type"))
    return images, listed.where(~valid).drop("p", "m")


def with_media(images: DataFrame, media: DataFrame) -> DataFrame:
    """Images with content from ``(media_id, content)``; error is MEDIA_NOT_FOUND where there is none."""
    joined = images.join(media.select("media_id", "content"), "media_id", "left")
    return joined.withColumn("error", F.when(F.col("content").isNull(), "MEDIA_NOT_FOUND"))


def extracted_by_hash(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Documents with the fields kept for their content's hash; unknown content is of type UNKNOWN, confidence 0."""
    hashed = documents.withColumn("content_hash", F.sha2("content", 256))
    fields = known.select(F.col("content_hash"), F.struct(*[f.name for f in EXTRACTED.fields]).alias("extracted"))
    unknown = F.struct(*[
        (F.lit("UNKNOWN") if f.name == "document_type" else F.lit(0.0) if f.name == "extraction_confidence" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in EXTRACTED.fields])
    return hashed.join(fields, "content_hash", "left").withColumn("extracted", F.coalesce("extracted", unknown))


def extracted_by(documents: DataFrame, extractor: Callable[[bytes], dict], seconds: float = 15.0) -> DataFrame:
    """``(external_id, extracted, error)`` by a function of a document's bytes, run in Arrow batches on the executors.

    What it raises, or a call longer than ``seconds``, is a row with an error and no fields, not a failed task.
    """
    names = [f.name for f in EXTRACTED.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import queue
        import threading

        def one(content: bytes, answer: queue.Queue) -> None:
            try:
                answer.put((extractor(content), None))
            except Exception as failure:  # any failure of one document stays its own
                answer.put((None, str(failure) or type(failure).__name__))

        for batch in batches:
            rows = []
            for key, content in zip(batch.external_id, batch.content, strict=True):
                answer: queue.Queue = queue.Queue(1)
                # A call that runs on ends with its worker and doesn't keep it.
                threading.Thread(target=one, args=(bytes(content), answer), daemon=True).start()
                try:
                    found, error = answer.get(timeout=seconds)
                except queue.Empty:
                    found, error = None, "extraction timed out"
                rows.append((key, found and {n: found.get(n) for n in names}, error))
            yield pd.DataFrame(rows, columns=["external_id", "extracted", "error"])

    schema = T.StructType([T.StructField("external_id", T.StringType()), T.StructField("extracted", EXTRACTED), T.StructField("error", T.StringType())])
    return documents.select("external_id", "content").mapInPandas(run, schema)
