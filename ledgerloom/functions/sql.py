"""The functions under names of their own in SQL: scalar ones as SQL functions, records of tax QR codes as a table."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ledgerloom.constants import ARABIC_DIGITS, FOLDED, MARKS, NO_LETTER, NOISE_TOKENS


def text(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


DIGITS = f"translate({{0}}, {text(ARABIC_DIGITS[0])}, {text(ARABIC_DIGITS[1])})"
FOLDED_NAME = f"regexp_replace({DIGITS.format(f'translate(regexp_replace(upper(name), {text(MARKS)}, {text('')}), {text(FOLDED[0])}, {text(FOLDED[1])})')}, {text(NO_LETTER)}, ' ')"
NOISE = "array(" + ", ".join(map(text, NOISE_TOKENS)) + ")"
#: Name, parameters and value of each function; names of merchants must be decomposed already, as ASCII is.
SCALARS = {
    "normalize_merchant": ("name STRING", f"array_join(filter(split({FOLDED_NAME}, {text(r'\s+')}), t -> t <> '' AND NOT t RLIKE {text(r'^\d+$')} AND NOT array_contains({NOISE}, t)), ' ')"),
    "normalize_identifier": ("value STRING", f"regexp_replace(upper(trim({DIGITS.format('value')})), {text('[^A-Z0-9؀-ۿ]')}, '')"),
    "normalize_card": ("value STRING", f"right(regexp_replace({DIGITS.format('value')}, '[^0-9]', ''), 4)"),
    "normalize_phone": ("value STRING", "CASE WHEN regexp_replace(value, '[^0-9]', '') <> '' THEN concat('+', regexp_replace(value, '[^0-9]', '')) ELSE value END")}


@udtf(returnType="tag int, value string", useArrow=True)
class QrTags:
    """``qr_tags(payload)``: tag and text of each record of a base64 payload, the last of equal tags; none of a broken one."""

    def eval(self, payload: str) -> Iterator[tuple[int, str]]:
        if payload is None:
            return
        plain = re.sub("[^A-Za-z0-9+/]", "", payload.strip(" ").split("=", 1)[0].translate(str.maketrans("-_", "+/")))
        plain = plain[:-1] if len(plain) % 4 == 1 else plain
        raw = base64.b64decode(plain + "=" * (-len(plain) % 4))
        at, found = 0, {}
        while at < len(raw):
            if at + 2 > len(raw) or at + 2 + raw[at + 1] > len(raw):
                return
            found.pop(raw[at], None)
            found[raw[at]] = raw[at + 2 : at + 2 + raw[at + 1]].decode("utf-8", "replace")
            at += 2 + raw[at + 1]
        if len(raw) >= 2:
            yield from found.items()


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, (parameters, value) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS STRING RETURN {value}")
    spark.udtf.register("qr_tags", QrTags)
