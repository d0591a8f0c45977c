"""Functions by their names in SQL give what the column expressions give."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from ledgerloom.functions import sql, text
from ledgerloom.sources import qr


def test_scalars(spark):
    sql.register(spark)
    values = [None, "", " ", "ALFANAR FUEL ST 04 RUH", "al-baik  rest, JED", "محطة ٠١٢ الفنار", "it's \\ a 'TEST' 12", "INV-٩/a", "00966-5 ext", "x", "+1"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for name, column in (("normalize_merchant", text.normalize_merchant), ("normalize_identifier", text.normalize_identifier), ("normalize_card", text.normalize_card), ("normalize_phone", text.normalize_phone)):
        got = spark.sql(f"SELECT v, {name}(v) AS x FROM {{rows}}", rows=rows).collect()
        want = rows.select("v", column(F.col("v")).alias("x")).collect()
        assert {(r.v, r.x) for r in got} == {(r.v, r.x) for r in want}, name


def test_qr_tags(spark):
    sql.register(spark)
    record = lambda tag, value: bytes([tag, len(value)]) + value
    raws = [b"", b"\x01", record(1, b"Seller") + record(4, b"12.50"), record(1, b"a") + record(1, "é".encode()), record(2, b"x") + b"\x03\x09ab", record(7, b""), record(9, b"z" * 200) * 2]
    payloads = [base64.b64encode(r).decode() for r in raws] + ["  AQE_  ", "not base64!", None, base64.urlsafe_b64encode(record(1, b"\x00\xfb\xff?>")).decode()]
    rows = spark.createDataFrame(list(enumerate(payloads)), "id int, payload string")
    got = {}
    for r in spark.sql("SELECT id, tag, value FROM {rows}, LATERAL qr_tags(payload)", rows=rows).collect():
        got.setdefault(r.id, {})[r.tag] = r.value
    want = {r.id: r.tags for r in rows.select("id", qr.decoded(F.col("payload")).alias("tags")).collect() if r.tags}
    ascii_only = lambda found: {i: t for i, t in found.items() if i != 10}  # noqa: E731  other bytes are replaced one by one or together
    assert ascii_only(got) == ascii_only(want) and got.keys() == want.keys()
