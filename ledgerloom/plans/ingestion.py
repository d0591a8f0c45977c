"""Received documents to their final status: identity, extraction, quality, duplicates, matching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.constants import MATCHER as M
from ledgerloom.functions.text import with_normalized
from ledgerloom.operators import decision, dedup
from ledgerloom.plans import matching
from ledgerloom.scratch import written
from ledgerloom.sources import qr

#: Fields of the matcher's documents that have a reliability of their own.
RELIABILITIES = {
    "amount": "totalAmount", "date": "documentDate", "merchant": "merchantName", "card": "cardLast4", "currency": "currency", "vat": "vatNumber",
    "invoice": "invoiceNumber", "auth": "authorizationCode"}


def matchable(documents: DataFrame) -> DataFrame:
    """Documents with the matcher's columns from their ``extracted`` fields; without a printed date the time of receipt."""
    e = F.col("extracted")
    date = F.try_to_timestamp(e["document_date"])
    return documents.select(
        "*", e["document_type"].alias("doc_type"), e["total_amount"].alias("doc_amount"), e["currency"].alias("doc_currency"), F.coalesce(date, "received_at").alias("doc_date"),
        F.when(date.isNull(), "RECEIVED_AT").otherwise("PRINTED").alias("doc_date_source"), e["card_last4"].alias("doc_card"), e["merchant_name"].alias("doc_merchant"),
        e["vat_number"].alias("doc_vat"), e["invoice_number"].alias("doc_invoice"), e["authorization_code"].alias("doc_auth"),
        *[F.try_element_at(e["field_confidences"], F.lit(key)).alias(f"conf_{name}") for name, key in RELIABILITIES.items()])


def unreadable_date(printed: Column) -> Column:
    """Whether a date is printed but none that can be read; no date at all is another thing."""
    return (F.trim(F.coalesce(printed, F.lit(""))) != "") & F.try_to_timestamp(printed).isNull()


def identified(received: DataFrame, client_email: DataFrame, ledger: DataFrame) -> DataFrame:
    """Received documents with doc_id, owner_key and content_hash, one for each provider id."""
    owned = dedup.owner_keys(received, client_email, ledger).withColumn("content_hash", dedup.content_hash(F.col("content"))).withColumn(
        "doc_id", F.shiftrightunsigned(F.xxhash64("source", "external_id"), 3))  # graphs of documents double their ids
    first = Window.partitionBy("source", "external_id").orderBy("received_at", "content_hash")
    return owned.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def marked_duplicates(documents: DataFrame, stored: DataFrame | None, key: str) -> DataFrame:
    """``documents`` with duplicate_of: the stored document, or the first of these, of the same owner and ``key``.

    The first is an aggregate, so that a key that many documents share is a row a task; null keys meet nothing.
    """
    own = dedup.first_of(documents.withColumn("id", F.col("doc_id")), ["owner_key", key], ["received_at", "external_id", "id"]).drop("id")
    if stored is not None:
        old = stored.where(F.col(key).isNotNull() & F.col("duplicate_of").isNull()).groupBy("owner_key", key).agg(F.min("doc_id").alias("_old"))
        own = own.join(old, ["owner_key", key], "left")
    else:
        own = own.withColumn("_old", F.lit(None).cast("long"))
    return own.withColumn("duplicate_of", F.coalesce("_old", "duplicate_of")).drop("_old")


def ingested(
    received: DataFrame, extract: Callable[[DataFrame], DataFrame], client_email: DataFrame, ledger: DataFrame, stored: DataFrame | None = None,
    matches: DataFrame | None = None, aliases: DataFrame | None = None, audit_rate: float = M.audit_rate,
) -> tuple[DataFrame, DataFrame]:
    """Documents with their status, and the match rows to store.

    ``received`` are (source, external_id, sender_identifier, received_at, content, mime_type); ``extract`` adds
    ``extracted`` and, where it failed, ``error``. ``stored`` are earlier results of this function. A document whose
    provider id is stored is left out; one whose content or fingerprint its owner has sent before is a DUPLICATE, which
    no later one can be a duplicate of; one that couldn't be read, or whose printed date can't, is FAILED; the others are MATCHED, NEEDS_REVIEW or
    UNMATCHED. The two tables are written to the shared folder once, so that both are of one run.
    """
    new = identified(received, client_email, ledger)
    if stored is not None:
        new = new.join(stored.select("source", "external_id"), ["source", "external_id"], "left_anti")
    hashed = written(marked_duplicates(new, stored, "content_hash"), "received")
    read = extract(hashed.where("duplicate_of is null").drop("duplicate_of"))
    if "error" not in read.columns:
        read = read.withColumn("error", F.lit(None).cast("string"))
    named = with_normalized(matchable(qr.enriched(read)), "doc_merchant", "doc_core")
    fields = [F.col(f"doc_{c}") for c in ("auth", "invoice", "vat", "core")]
    printed = named.withColumn("fingerprint", dedup.fingerprint(*fields, F.col("extracted")["qr_payload"])).drop("doc_core")
    probed = written(marked_duplicates(printed.drop("content"), stored, "fingerprint"), "extracted")
    unread = (F.col("doc_type") == "UNKNOWN") | (F.coalesce(F.col("extracted")["extraction_confidence"], F.lit(0.0)) < M.min_extraction) | F.col("doc_amount").isNull()
    bad_date = unreadable_date(F.col("extracted")["document_date"])
    failed = F.when(F.col("error").isNotNull(), "EXTRACTION_ERROR").when(F.coalesce(unread, F.lit(True)), "LOW_QUALITY_EXTRACTION").when(bad_date, "PIPELINE_ERROR")
    judged = probed.withColumn("failure", F.when(F.col("duplicate_of").isNull(), failed)).withColumn("error", F.when(
        F.col("failure") == "PIPELINE_ERROR", F.concat(F.lit("pipeline: unreadable date "), F.col("extracted")["document_date"])).otherwise(F.col("error")))
    good = judged.where("duplicate_of is null and failure is null")
    final = written(matching.match(good.select(*[c for c in good.columns if c.startswith(("doc_", "conf_"))], "source", "sender_identifier", "received_at"),
                                   ledger, client_email, matches, aliases, audit_rate), "matched")
    keys = ["doc_id", "source", "external_id", "sender_identifier", "owner_key", "received_at", "content_hash"]
    copies = hashed.where("duplicate_of is not null").select(*keys, "duplicate_of", F.lit("DUPLICATE").alias("status"))
    rest = judged.join(final.select("doc_id", "status", "status_reason", "tx_id"), "doc_id", "left").select(
        *keys, "fingerprint", "extracted", "duplicate_of", F.when(F.col("duplicate_of").isNotNull(), "DUPLICATE").when(F.col("failure").isNotNull(), "FAILED").otherwise(F.col("status")).alias("status"),
        F.coalesce("failure", "status_reason").alias("status_reason"), F.col("error").alias("error_message"), "tx_id")
    return rest.unionByName(copies, allowMissingColumns=True), decision.match_rows(final)
