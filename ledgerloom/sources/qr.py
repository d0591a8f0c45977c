"""Tax QR codes: tag, length, value records in base64, decoded and merged into extracted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import lenient_base64

#: Tags of the fields.
TAGS = {1: "seller", 2: "vat", 3: "timestamp", 4: "total", 5: "vat_amount"}


#: Records that are stepped through first; payloads with more go on through a fold over as many as their bytes allow.
USUAL_RECORDS = 8


def decoded(payload: Column) -> Column:
    """Tag to text of a base64 payload; null if it is shorter than a record or a length runs over its end.

    A fold from record to record. The last of equal tags counts; bytes that aren't UTF-8 become replacement characters.
    """
    empty = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))

    def of_bytes(raw: Column) -> Column:
        size = F.length(raw)
        byte = lambda at: F.conv(F.hex(F.substring(raw, at, F.lit(1))), 16, 10).cast("int")
        start = F.struct(F.lit(1).alias("next"), F.lit(False).alias("bad"), empty.alias("found"))

        def step(state: Column, _: Column) -> Column:
            at = state["next"]
            length = F.coalesce(byte(at + 1), F.lit(0))
            over = (at + 1 > size) | (at + 1 + length > size)
            value = F.make_valid_utf8(F.substring(raw, at + 2, length).cast("string"))
            kept = F.map_concat(F.map_filter(state["found"], lambda k, _: k != byte(at)), F.create_map(F.coalesce(byte(at), F.lit(0)), value))
            return F.when(state["bad"] | (at > size), state).when(over, F.struct(at.alias("next"), F.lit(True).alias("bad"), state["found"].alias("found"))).otherwise(
                F.struct((at + 2 + length).alias("next"), F.lit(False).alias("bad"), kept.alias("found")))

        first = F.aggregate(F.sequence(F.lit(1), F.lit(USUAL_RECORDS)), start, step)
        rest = F.greatest(F.lit(1), F.ceil(size / 2).cast("int") - USUAL_RECORDS)
        end = lambda state: F.when(state["bad"] | (state["next"] > size), state).otherwise(
            F.aggregate(F.sequence(F.lit(1), rest), state, step))
        done = F.get(F.transform(F.array(first), end), F.lit(0))
        return F.when(size >= 2, F.get(F.transform(F.array(done), lambda state: F.when(~state["bad"], state["found"])), F.lit(0)))

    return F.get(F.transform(F.array(lenient_base64(F.trim(payload))), of_bytes), F.lit(0))


def decimal_to_minor(text: Column) -> Column:
    """Minor units of a plain decimal with at most two places; null for anything else or past 2^53."""
    whole = F.split(text, r"\.")[0]
    part = F.rpad(F.coalesce(F.get(F.split(text, r"\."), F.lit(1)), F.lit("")), 2, "0")
    value = F.try_to_number(F.concat(whole, part), F.lit("9" * 24))
    return F.when(text.rlike(r"^\d+(\.\d{1,2})?$") & (value <= 9007199254740991), value.cast("long"))


def valid_iso(text: Column) -> Column:
    """The time as ISO text in UTC; null where it can't be read."""
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def enriched(documents: DataFrame, extracted: str = "extracted") -> DataFrame:
    """Documents whose extracted fields are filled from the QR code where they are null, those at reliability 0.99."""
    e = F.col(extracted)
    tags = documents.withColumn("_qr", decoded(e["qr_payload"]))
    tag = lambda n: F.nullif(F.try_element_at("_qr", F.lit(n)), F.lit(""))
    total = decimal_to_minor(tag(4))
    filled = {"merchant_name": tag(1), "vat_number": tag(2), "document_date": valid_iso(tag(3)), "total_amount": total, "currency": F.when(total.isNotNull(), "SAR")}
    names = {"merchant_name": "merchantName", "vat_number": "vatNumber", "document_date": "documentDate", "total_amount": "totalAmount", "currency": "currency"}
    gained = F.map_from_entries(F.filter(F.array(*[
        F.when(e[f].isNull() & v.isNotNull(), F.struct(F.lit(names[f]).alias("key"), F.lit(0.99).alias("value"))) for f, v in filled.items()]), lambda x: x.isNotNull()))
    old = F.coalesce(e["field_confidences"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    new = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(gained, k)), gained)
    out = e
    for field, value in filled.items():
        out = out.withField(field, F.coalesce(e[field], value))
    return tags.withColumn(extracted, F.when(F.col("_qr").isNull(), e).otherwise(out.withField("field_confidences", new))).drop("_qr")
