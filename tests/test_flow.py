"""From payload files to stored documents and matches, and transactions that come after their documents."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dedup
from ledgerloom.plans import ingestion
from ledgerloom.plans.store import Store
from ledgerloom.sources import webhooks
from ledgerloom.streaming import flow, ingest
from test_matching import emails, ledger

SENDER = "fleet@alrashed.example"
#: By content: kind, merchant, amount, printed date, invoice.
READ = {
    "auto": ("TAX_INVOICE", "Alrajhi Auto Service", 120000, "2025-06-20 10:04:00", "AR-1"), "late": ("RECEIPT", "Late Garage", 7700, "2025-06-01 12:00:00", None),
    "later": ("RECEIPT", "Late Garage", 7700, "2025-06-01 12:01:00", None), "blurred": ("UNKNOWN", None, None, None, None), "odd date": ("RECEIPT", "ALFANAR FUEL STATION", 25000, "not-a-date", None),
    "same": ("TAX_INVOICE", "Alrajhi Auto Service", 120000, "2025-06-20 10:04:00", "AR-1"), "old": ("RECEIPT", "Never Found", 4321, "2025-01-01 12:00:00", None)}


def mail(name, content, received="2025-06-21T09:00:00Z"):
    return json.dumps({"messageId": name, "from": SENDER, "to": "in@x.example", "subject": "s", "receivedAt": received, "attachments": [
        {"filename": "f.png", "contentType": "image/png", "contentBase64": base64.b64encode(content.encode()).decode()}]})


def known(spark):
    rows = [(hashlib.sha256(c.encode()).hexdigest(), *fields, "SAR", "4411", 0.9) for c, fields in READ.items()]
    frame = spark.createDataFrame(rows, "content_hash string, document_type string, merchant_name string, total_amount long, document_date string, invoice_number string, currency string, card_last4 string, extraction_confidence double")
    for field in webhooks.EXTRACTED.fields:
        if field.name not in frame.columns:
            frame = frame.withColumn(field.name, F.lit(None).cast(field.dataType))
    return frame


def add(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as file:
        file.write("\n".join(lines) + "\n")


def statuses(store):
    return {r.external_id: (r.status, r.status_reason, r.tx_id) for r in store.documents().collect()}


def test_payloads_to_late_match(spark, tmp_path):
    payloads, txs, points = f"{tmp_path}/payloads", f"{tmp_path}/ledger", f"{tmp_path}/points"
    arrived = lambda frame, at: frame.withColumn("arrived_at", F.lit(at).cast("timestamp"))
    arrived(ledger(spark), "2025-06-20 00:00:00").coalesce(1).write.parquet(txs)
    schema = spark.read.parquet(txs).schema
    store, all_known = Store(spark, f"{tmp_path}/store"), known(spark)
    read_ledger = lambda: spark.read.schema(schema).parquet(txs).drop("arrived_at")

    def ingest_all():
        stream = ingest.read_payloads(spark, payloads, files_at_once=1)
        flow.start_ingestion(
            stream, store, f"{points}/in", lambda d: webhooks.extracted_by_hash(d.drop("content_hash"), all_known), emails(spark), read_ledger, audit_rate=0).awaitTermination()

    def rematch_all():
        stream = spark.readStream.schema(schema).parquet(txs)
        flow.start_rematching(spark, store, stream, f"{points}/late", emails(spark), read_ledger).awaitTermination()

    add(payloads, "1.txt", [mail("m1", "auto"), mail("m1", "auto"), mail("m2", "auto"), mail("m3", "late"), "{broken"])
    add(payloads, "2.txt", [mail("m4", "blurred"), mail("m5", "odd date"), mail("m6", "same"), mail("m7", "old"), mail("m1", "auto")])
    ingest_all()
    before = statuses(store)
    assert {k: v[:2] for k, v in before.items() if k not in ("m3", "m7")} == {
        "m1": ("MATCHED", "AUTO_MATCHED"), "m2": ("DUPLICATE", None), "m4": ("FAILED", "LOW_QUALITY_EXTRACTION"), "m5": ("FAILED", "PIPELINE_ERROR"), "m6": ("DUPLICATE", None)}
    assert (before["m3"][0], before["m7"][0]) == ("UNMATCHED", "UNMATCHED")
    bad = store.documents().where("external_id = 'm5'").first()
    assert bad.error_message.startswith("pipeline:") and "not-a-date" in bad.error_message
    assert [(r.transaction_id, r.status) for r in store.matches().collect()] == [(4, "AUTO_CONFIRMED")]
    assert store.table("rejected").count() == 1
    rematch_all()  # the documents, and only the old transactions: nothing to match
    assert statuses(store) == before
    ingest_all()  # nothing new
    assert statuses(store) == before

    late = ledger(spark).where("tx_id = 4").withColumns({
        "tx_id": F.lit(99).cast("long"), "tx_merchant": F.lit("LATE GARAGE RUH"), "tx_amount": F.lit(7700).cast("long"), "tx_vat": F.lit(None).cast("string"),
        "tx_at": F.lit("2025-06-01 12:05:00").cast("timestamp")})
    arrived(late, "2025-06-23 00:00:00").coalesce(1).write.mode("append").parquet(txs)
    rematch_all()  # a new query on the old checkpoint, as after a restart
    now = statuses(store)
    assert now["m3"] == ("MATCHED", "AUTO_MATCHED_AFTER_REMATCH", 99) and {k: v for k, v in now.items() if k != "m3"} == {k: v for k, v in before.items() if k != "m3"}
    rows = {r.transaction_id: (r.status, r.decided_by, r.rank) for r in store.matches().collect()}
    assert rows == {4: ("AUTO_CONFIRMED", "system", 1), 99: ("AUTO_CONFIRMED", "system-rematch", 1)}

    # A document that comes after its transaction was used: it goes to review, never to the same transaction by itself.
    add(payloads, "3.txt", [mail("m8", "later", "2025-06-24T09:00:00Z")])
    ingest_all()
    assert statuses(store)["m8"][0] == "NEEDS_REVIEW"


def test_waiting_documents_are_forgotten(spark, tmp_path):
    """State ends with a document's patience: a transaction that comes after it calls only documents received later."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", flow.STATE_STORE)
    day = lambda n: dt.datetime(2025, 6, 1) + dt.timedelta(days=n)
    kind = "doc_id long, source string, sender_identifier string, doc_date timestamp, received_at timestamp"
    docs = lambda rows: spark.createDataFrame([(i, "EMAIL", SENDER, day(0), day(n)) for i, n in rows], kind)
    base = ledger(spark).where("tx_id = 5").withColumn("arrived_at", F.col("tx_at"))

    def called(new_docs, transactions):
        """The documents that new ones and transactions, by day and day of arrival, call."""
        if new_docs:
            docs(new_docs).coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
        for n, arrived in transactions:
            base.withColumn("tx_at", F.lit(day(n))).withColumn("arrived_at", F.lit(day(arrived))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/txs")
        due = flow.due_documents(
            spark.readStream.schema(kind).parquet(f"{tmp_path}/docs"), spark.readStream.schema(base.schema).parquet(f"{tmp_path}/txs"), emails(spark), patience_days=20, lateness="1 day")
        found = set()
        flow.started(due.writeStream.foreachBatch(lambda rows, _: found.update(r.doc_id for r in rows.collect())), f"{tmp_path}/point", True).awaitTermination()
        return found

    big = (1 << 60) + 1  # ids beyond what a double holds
    assert called([(1, 0), (big, 2)], [(-200, 0)]) == set()
    assert called([], [(3, 3)]) == {1, big}
    assert called([(2, 55)], [(300, 60)]) == set()  # the watermark passes the patience of the first two
    assert called([], [(3, 61)]) == {2}


@pytest.mark.parametrize("text,bad", [("not-a-date", True), ("", False), ("  ", False), (None, False), ("2025-06-01", False), ("2025-06-01T10:00:00Z", False), ("2025-13-01", True)])
def test_unreadable_dates(spark, text, bad):
    frame = spark.createDataFrame([(text,)], "d string")
    assert frame.select(ingestion.unreadable_date(F.col("d")).alias("bad")).first().bad is bad


def test_first_of_against_force(spark):
    rows = [(i, k, v) for i, (k, v) in enumerate([("a", 1), ("a", 1), (None, 1), (None, 1), ("a", None), ("a", None), ("b", 1), ("a", 1), ("b", 2)])]
    frame = spark.createDataFrame([(100 - i, k, v, i) for i, k, v in rows], "id long, k string, v long, at long")
    got = {r.id: r.duplicate_of for r in dedup.first_of(frame, ["k", "v"], ["at"]).collect()}
    assert got == {100: None, 99: 100, 98: None, 97: None, 96: None, 95: None, 94: None, 93: 100, 92: None}
