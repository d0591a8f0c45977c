from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time

from pyspark.sql import functions as F

from ledgerloom.sources import qr, webhooks
from ledgerloom.streaming import ingest


def test_signature(spark):
    body, secret = '{"a": 1}', "s" * 70
    good = hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([(1, body, f"sha256={good}"), (2, body, good.upper()), (3, body + " ", good), (4, body, None), (5, body, "sha256=zz")], "n int, b string, h string")
    got = {r.n: r.signature for r in webhooks.verified_signature(rows, "b", "h", secret).collect()}
    assert got == {1: "OK", 2: "OK", 3: "MISMATCH", 4: "MISSING", 5: "MALFORMED"}
    assert {r.signature for r in webhooks.verified_signature(rows, "b", "h", None).collect()} == {"NOT_ENFORCED"}


def tlv(*records):
    return base64.b64encode(b"".join(bytes([t, len(v.encode())]) + v.encode() for t, v in records)).decode()


def test_qr(spark):
    full = tlv((1, "متجر"), (2, "300123456700003"), (3, "2025-06-14T08:15:00Z"), (4, "250.50"), (5, "32.67"))
    rows = spark.createDataFrame([(1, full), (2, base64.b64encode(b"\x01\x09ab").decode()), (3, "AA=="), (4, tlv((1, "a"), (1, "b"))), (5, None)], "n int, q string")
    got = {r.n: r.t for r in rows.select("n", qr.decoded(F.col("q")).alias("t")).collect()}
    assert got[1] == {1: "متجر", 2: "300123456700003", 3: "2025-06-14T08:15:00Z", 4: "250.50", 5: "32.67"}
    assert got[2] is None and got[3] is None and got[4] == {1: "b"} and got[5] is None
    money = spark.createDataFrame([("250.50",), ("32.6",), ("7",), ("1.234",), ("x",), (None,), ("99999999999999999999",)], "t string")
    assert [r[0] for r in money.select(qr.decimal_to_minor(F.col("t"))).collect()] == [25050, 3260, 700, None, None, None, None]


def mail(n, attachments, sender="A@b.example"):
    return json.dumps({"messageId": f"m{n}", "from": sender, "to": "in@b.example", "subject": "s", "receivedAt": "2025-06-14T08:00:00Z", "attachments": [{"filename": "f", "contentType": "image/png", "contentBase64": base64.b64encode(a.encode()).decode()} for a in attachments]})


def test_mails(spark):
    raw = spark.createDataFrame([(mail(1, ["x"]),), (mail(2, ["y", "z"]),), (mail(3, []),), (mail(4, ["x"], "nobody"),), ("no json",)], "body string")
    documents, rejected = webhooks.email_documents(raw)
    assert {(r.external_id, bytes(r.content)) for r in documents.collect()} == {("m1", b"x"), ("m2::0", b"y"), ("m2::1", b"z")}
    assert rejected.count() == 3


def test_failing_extractor(spark):
    rows = spark.createDataFrame([("a", b"good"), ("b", b"bad"), ("c", b"slow")], "external_id string, content binary")

    def extractor(content):
        if content == b"bad":
            raise ValueError("unreadable")
        if content == b"slow":
            time.sleep(1)
        return {"document_type": "RECEIPT", "total_amount": 5, "extraction_confidence": 0.9}

    got = {r.external_id: r for r in webhooks.extracted_by(rows, extractor, seconds=0.3).collect()}
    assert got["a"].extracted.total_amount == 5 and got["a"].error is None
    assert got["b"].error == "unreadable" and got["c"].error == "extraction timed out"


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.txt").write_text("\n".join([mail(1, ["x"]), mail(1, ["x"]), mail(2, ["y", "z"]), "junk"]))
    paths = [str(tmp_path / p) for p in ("documents", "rejected", "checkpoint")]
    for more in ("", mail(2, ["y", "z"]) + "\n" + mail(5, ["x"]) + "\n" + mail(6, ["w"])):
        if more:
            (source / "2.txt").write_text(more)
        ingest.start(ingest.read_payloads(spark, str(source)), *paths).awaitTermination()
    stored = spark.read.parquet(paths[0])
    assert sorted(r.external_id for r in stored.collect()) == ["m1", "m2::0", "m2::1", "m6"]
    assert spark.read.parquet(paths[1]).count() == 1


def test_bad_payloads_do_not_fail_the_job(spark):
    odd = json.loads(mail(1, ["x"]))
    odd["attachments"][0]["contentBase64"] = "a"
    documents, rejected = webhooks.email_documents(spark.createDataFrame([(json.dumps(odd),), (mail(2, ["y"]),)], "body string"))
    assert {(r.external_id, bytes(r.content)) for r in documents.collect()} == {("m1", b""), ("m2", b"y")} and rejected.count() == 0
    chats = [chat(1, "1750000000"), chat(2, "9" * 20), chat(3, "9" * 15), chat(4, "12x")]
    images, refused = webhooks.message_images(spark.createDataFrame([(c,) for c in chats], "body string"))
    assert [r.external_id for r in images.collect()] == ["w1"] and refused.count() == 3
    codes = [base64.b64encode(b"\x01\x02\xff\xfe").decode(), "AQFh=", "AQF", "A", "é", base64.b64encode(bytes([1, 1, 97]) * 40).decode(), base64.b64encode(bytes([1, 1, 97]) * 40 + b"\x02").decode()]
    got = [r.t for r in spark.createDataFrame([(c,) for c in codes], "q string").select(qr.decoded(F.col("q")).alias("t")).collect()]
    assert got[0] == {1: "��"} and got[1] == {1: "a"} and got[5] == {1: "a"} and [got[i] for i in (2, 3, 4, 6)] == [None] * 4


def chat(n, timestamp="1750000000", sender="966501111111", media="p1"):
    message = {"id": f"w{n}", "from": sender, "timestamp": timestamp, "type": "image", "image": {"id": media, "mime_type": "image/jpeg"}}
    return json.dumps({"entry": [{"changes": [{"value": {"messages": [message]}}]}]})


def test_stream_survives_bad_payloads_and_knows_owners(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    odd = json.loads(mail(1, ["x"]))
    odd["attachments"][0]["contentBase64"] = "a"
    lines = [json.dumps(odd), chat(1, "9" * 20), mail(2, ["y"], "One@b.example"), mail(3, ["y"], "two@b.example"), chat(2), chat(3, media="lost")]
    (source / "1.txt").write_text("\n".join(lines))
    emails = spark.createDataFrame([(1, 1, "one@b.example"), (2, 1, "two@b.example")], "id long, client_id long, email string")
    ledger = spark.createDataFrame([("+966501111111", 1)], "driver_phone string, client_id long")
    media = spark.createDataFrame([("p1", b"picture")], "media_id string, content binary")
    paths = [str(tmp_path / p) for p in ("documents", "rejected", "checkpoint")]
    ingest.start(ingest.read_payloads(spark, str(source)), *paths, owners=(emails, ledger), media=media).awaitTermination()
    assert sorted((r.external_id, r.owner_key) for r in spark.read.parquet(paths[0]).collect()) == [("m1", "email:a@b.example"), ("m2", "client:1"), ("w2", "client:1")]
    assert spark.read.parquet(paths[1]).count() == 2


def test_media_known_fields_and_dates(spark):
    images, _ = webhooks.message_images(spark.createDataFrame([(chat(1),), (chat(2, media="lost"),)], "body string"))
    media = spark.createDataFrame([("p1", b"picture")], "media_id string, content binary")
    assert {r.external_id: r.error for r in webhooks.with_media(images, media).collect()} == {"w1": None, "w2": "MEDIA_NOT_FOUND"}
    known = spark.createDataFrame([(hashlib.sha256(b"picture").hexdigest(), "RECEIPT", 0.9)], "content_hash string, document_type string, extraction_confidence double")
    for field in webhooks.EXTRACTED.fields:
        if field.name not in known.columns:
            known = known.withColumn(field.name, F.lit(None).cast(field.dataType))
    found = {r.external_id: r.extracted for r in webhooks.extracted_by_hash(webhooks.with_media(images, media), known).collect()}
    assert (found["w1"].document_type, found["w2"].document_type, found["w2"].extraction_confidence) == ("RECEIPT", "UNKNOWN", 0.0)
    dates = spark.createDataFrame([("2025-06-14T08:15:00Z",), ("never",), (None,)], "t string").select(qr.valid_iso(F.col("t"))).collect()
    assert [r[0] for r in dates] == ["2025-06-14T08:15:00.000Z", None, None]


def test_qr_fills_what_is_missing(spark):
    code = tlv((1, "Seller"), (2, "300"), (4, "12.5"))
    rows = spark.createDataFrame([(None, 700, code), ("Own", None, "")], "merchant_name string, total_amount long, qr_payload string")
    for field in webhooks.EXTRACTED.fields:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    packed = rows.select(F.struct(*[f.name for f in webhooks.EXTRACTED.fields]).alias("extracted"))
    one, two = [r.extracted for r in qr.enriched(packed).collect()]
    assert (one.merchant_name, one.total_amount, one.vat_number, one.currency) == ("Seller", 700, "300", "SAR")
    assert one.field_confidences == {"merchantName": 0.99, "vatNumber": 0.99, "currency": 0.99}
    assert (two.merchant_name, two.total_amount, two.field_confidences) == ("Own", None, None)


def test_windows_and_watermarks(spark, tmp_path):
    for n, rows in enumerate([[(1, "08:00"), (1, "08:10"), (2, "08:50")], [(3, "12:00")], [(4, "08:30"), (3, "12:01")]]):
        frame = spark.createDataFrame([("EMAIL", f"m{i}", f"2025-06-14 {t}:00") for i, t in rows], "source string, external_id string, at string")
        frame.select("source", "external_id", F.to_timestamp("at").alias("received_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"n={n}"))
    for name, work in (("activity", ingest.activity), ("first", ingest.first_seen)):
        stream = spark.readStream.schema("source string, external_id string, received_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        work(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    first = sorted(r.external_id for r in spark.table("first").collect())
    assert first.count("m1") == 1 and {"m1", "m2", "m3"} <= set(first)
    assert {r.window.start.hour: r.n for r in spark.table("activity").collect()}[8] in (3, 4)
