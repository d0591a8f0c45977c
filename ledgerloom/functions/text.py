"""Normalisation of names, identifiers, phones and digits, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.constants import ARABIC_DIGITS, CITIES, FOLDED, MARKS, NO_LETTER, NOISE_TOKENS, ONE_LETTER, TWO_LETTERS

#: Java's word boundary counts Arabic letters as word characters; these look at Latin letters, digits and _ only.
START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def latin_digits(c: Column | str) -> Column:
    return F.translate(column(c), *ARABIC_DIGITS)


def normalize_digits(c: Column | str) -> Column:
    return F.regexp_replace(latin_digits(c), "[^0-9]", "")


def normalize_identifier(c: Column | str) -> Column:
    return F.regexp_replace(F.upper(F.trim(latin_digits(c))), r"[^A-Z0-9؀-ۿ]", "")


def normalize_currency(c: Column | str) -> Column:
    return F.upper(F.trim(column(c)))


def normalize_phone(c: Column | str) -> Column:
    digits = F.regexp_replace(column(c), "[^0-9]", "")
    return F.when(digits != "", F.concat(F.lit("+"), digits)).otherwise(column(c))


def normalize_card(c: Column | str) -> Column:
    return F.right(normalize_digits(c), F.lit(4))


def transliterate(c: Column | str) -> Column:
    out = column(c)
    for letter, latin in TWO_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(latin))
    return F.translate(out, *ONE_LETTER)


def folded(c: Column | str) -> Column:
    """Upper case without marks, tatweel and letter variants; what isn't a letter, digit or space becomes a space."""
    plain = F.regexp_replace(F.upper(column(c)), MARKS, "")
    return F.regexp_replace(latin_digits(F.translate(plain, *FOLDED)), NO_LETTER, " ")


def merchant_tokens(c: Column | str) -> Column:
    noise = F.array(*[F.lit(t) for t in NOISE_TOKENS])
    return F.filter(F.split(folded(c), r"\s+"), lambda t: (t != "") & ~t.rlike(r"^\d+$") & ~F.array_contains(noise, t))


def normalize_merchant(c: Column | str) -> Column:
    """A merchant's name without case, marks, numbers and noise words. Names must be decomposed already, as ASCII is."""
    return F.array_join(merchant_tokens(c), " ")


@F.pandas_udf(StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else unicodedata.normalize("NFKD", n.upper()))


def merchant_dictionary(names: DataFrame, name: str) -> DataFrame:
    """``(name, normalized)`` of each distinct non-null name, from one pass over the rows. Only names beyond ASCII are read by Python."""
    each = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    beyond = F.when(~F.col("name").rlike(r"^[\x00-\x7F]*$"), F.col("name"))
    return each.select("name", F.coalesce(_decomposed(beyond), "name").alias("decomposed")).select("name", normalize_merchant("decomposed").alias("normalized"))


def with_normalized(rows: DataFrame, name: str, out: str) -> DataFrame:
    """``rows`` with the normalised form of the column ``name``; each distinct name is looked at once, null stays null."""
    known = merchant_dictionary(rows, name).select(F.col("name").alias(f"__{out}"), F.col("normalized").alias(out))
    return rows.join(known, F.col(name) == F.col(f"__{out}"), "left").drop(f"__{out}")


def lenient_base64(c: Column | str) -> Column:
    """Bytes of base64 text in either alphabet: up to its padding, other signs skipped, a lone last sign left out."""
    plain = F.regexp_replace(F.translate(F.substring_index(column(c), "=", 1), "-_", "+/"), "[^A-Za-z0-9+/]", "")
    whole = F.when(F.length(plain) % 4 == 1, F.left(plain, F.length(plain) - 1)).otherwise(plain)
    return F.unbase64(F.concat(whole, F.repeat(F.lit("="), F.pmod(-F.length(whole), F.lit(4)))))


def numeric_entries(json: Column | str) -> Column:
    """The entries of a JSON object whose values are numbers; empty for anything else."""
    entries = F.try_variant_get(F.try_parse_json(column(json)), "$", "map<string,variant>")
    kind = lambda v: F.schema_of_variant(v)
    numbers = F.map_filter(entries, lambda _, v: kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))
    return F.coalesce(F.transform_values(numbers, lambda _, v: F.try_variant_get(v, "$", "double")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))


def text_items(json: Column | str) -> Column:
    """The strings of a JSON array; empty for anything else."""
    items = F.try_variant_get(F.try_parse_json(column(json)), "$", "array<variant>")
    texts = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(texts, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))


def merchant_city(c: Column | str) -> Column:
    upper = F.regexp_replace(F.upper(column(c)), r"[^A-Z0-9؀-ۿ\s]", " ")
    out = None
    for city, latin, arabic in CITIES:
        hit = upper.rlike(f"{START}(?:{latin}){END}|{arabic}")
        out = F.when(hit, city) if out is None else out.when(hit, city)
    return out


def merchant_branch(c: Column | str) -> Column:
    upper = F.regexp_replace(F.upper(column(c)), r"[^A-Z0-9؀-ۿ\s]", " ")
    explicit = F.regexp_extract(upper, rf"(?:{START}BR(?:ANCH)?{END}|فرع)\s*([0-9٠-٩]+)", 1)
    acquirer = F.regexp_extract(upper, rf"{START}(?:ST|STORE|BR)\s+([0-9]+){END}", 1)
    return F.coalesce(F.nullif(normalize_digits(explicit), F.lit("")), F.nullif(acquirer, F.lit("")))


def merchant_descriptor(c: Column | str) -> Column:
    return F.struct(normalize_merchant(c).alias("core"), merchant_city(c).alias("city"), merchant_branch(c).alias("branch"))


def round3(c: Column) -> Column:
    """Half up to three places, on doubles."""
    return F.floor(c * 1000 + F.lit(0.5)).cast("double") / 1000


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def percent(c: Column) -> Column:
    return F.concat(F.floor(c * 100 + F.lit(0.5)).cast("long").cast("string"), F.lit("%"))


def format_money(minor: Column, currency: Column) -> Column:
    """Minor units as a two-place amount and its currency; a dash for null."""
    return F.when(minor.isNull(), "—").otherwise(F.concat_ws(" ", F.format_string("%.2f", minor.cast("double") / 100), currency))


def signal_label(score: Column) -> Column:
    return F.when(score >= 0.9, "strong").when(score <= 0.05, "conflict").otherwise("partial")
