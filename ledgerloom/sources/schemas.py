"""Schemas of all tables and payloads; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()), "MAP<STRING,DOUBLE>": T.MapType(T.StringType(), T.DoubleType())}


def _schema(columns: str) -> T.StructType:
    """A flat schema from ``name TYPE, ...``; it takes no session, as DDL would."""
    pairs = [c.split(" ") for c in columns.split(", ")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


CLIENT = _schema("id BIGINT, name STRING")
CLIENT_EMAIL = _schema("id BIGINT, client_id BIGINT, email STRING")
LEDGER = _schema(
    "id BIGINT, client_id BIGINT, card_last4 STRING, driver_phone STRING, merchant_name STRING, merchant_vat_number STRING, invoice_number STRING, "
    "authorization_code STRING, merchant_category STRING, merchant_city STRING, amount BIGINT, currency STRING, transaction_at TIMESTAMP")
EXTRACTED = _schema(
    "document_type STRING, merchant_name STRING, vat_number STRING, total_amount BIGINT, currency STRING, document_date STRING, card_last4 STRING, "
    "invoice_number STRING, authorization_code STRING, qr_payload STRING, field_confidences MAP<STRING,DOUBLE>, raw_text STRING, extraction_confidence DOUBLE")
DOCUMENT = T.StructType(EXTRACTED.fields + _schema(
    "id BIGINT, source STRING, external_id STRING, content_hash STRING, semantic_fingerprint STRING, owner_key STRING, sender_identifier STRING, status STRING, "
    "error_message STRING, review_reason STRING, status_reason STRING, status_details STRING, received_at TIMESTAMP, updated_at TIMESTAMP").fields)
MATCH = _schema(
    "id BIGINT, document_id BIGINT, transaction_id BIGINT, confidence DOUBLE, decision_confidence DOUBLE, signals MAP<STRING,DOUBLE>, evidence_coverage DOUBLE, "
    "contradictions ARRAY<STRING>, rank INT, status STRING, decided_by STRING, decided_at TIMESTAMP, matcher_version STRING, explanation STRING, "
    "explanation_input_hash STRING, explanation_prompt_version STRING")
ALIAS = _schema(
    "client_id BIGINT, alias STRING, normalized_alias STRING, canonical_merchant_name STRING, canonical_normalized STRING, confirmation_count BIGINT, last_confirmed_at TIMESTAMP")
#: Of nested columns, as DDL.
SNAPSHOT = "ARRAY<STRUCT<place INT, id BIGINT, transaction_id BIGINT, rank INT, confidence DOUBLE, decision_confidence DOUBLE, evidence_coverage DOUBLE, contradictions ARRAY<STRING>, status STRING>>"
EVENT = (
    "id BIGINT, document_id BIGINT, match_id BIGINT, transaction_id BIGINT, action STRING, reason STRING, decided_by STRING, matcher_version STRING, "
    f"candidate_snapshot {SNAPSHOT}, created_at TIMESTAMP")
PREDICTION = _schema("score DOUBLE, correct BOOLEAN, auto_matched BOOLEAN, rank_of_correct INT")
EDGE = _schema("document_id BIGINT, transaction_id BIGINT, score DOUBLE")
EMAIL_PAYLOAD = (
    "messageId STRING, `from` STRING, `to` STRING, subject STRING, receivedAt STRING, attachments ARRAY<STRUCT<filename STRING, contentType STRING, contentBase64 STRING>>")
MESSAGE_PAYLOAD = (
    "entry ARRAY<STRUCT<changes ARRAY<STRUCT<value STRUCT<messages ARRAY<STRUCT<id STRING, `from` STRING, timestamp STRING, type STRING, "
    "image STRUCT<id STRING, mime_type STRING, sha256 STRING>>>>>>>>")
