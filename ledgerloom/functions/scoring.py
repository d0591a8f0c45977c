"""Similarity of a document and a ledger transaction, as column expressions over a table of pairs."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.constants import CORE_SIGNALS
from ledgerloom.constants import MATCHER as M
from ledgerloom.functions.text import (
    END,
    START,
    clamp01,
    column,
    normalize_currency,
    normalize_digits,
    normalize_identifier,
    round3,
    transliterate,
)


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def score_amount(doc: Column, tx: Column, allow_tip: Column) -> Column:
    """1 within the tolerance; below, a tip falls to one half; a little above, nearly one."""
    d, t = doc.cast("double"), tx.cast("double")
    tolerance = F.greatest(F.lit(M.absolute_tolerance), half_up(t * M.relative_tolerance))
    short = (t - d) / t
    return (
        F.when((d <= 0) | (t <= 0), 0.0)
        .when(F.abs(d - t) <= tolerance, 1.0)
        .when(d < t, F.when(allow_tip & (short <= M.tip), F.lit(1.0) - (short / M.tip) * 0.5).otherwise(0.0))
        .when((d - t) / t <= M.overshoot, M.overshoot_score)
        .otherwise(0.0)
    )


def local_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, M.timezone))


def score_date(doc: Column, tx: Column) -> Column:
    """1 on one local date; then by days apart, to 0.2 at fourteen."""
    days = F.abs(F.unix_millis(doc) - F.unix_millis(tx)).cast("double") / 86_400_000.0
    return (
        F.when(local_date(doc) == local_date(tx), 1.0)
        .when(days <= 1, 0.98)
        .when(days <= M.near_days, F.lit(0.98) - ((days - 1) / 2) * 0.28)
        .when(days <= M.max_days, F.lit(0.7) - ((days - 3) / 11) * 0.5)
        .otherwise(0.0)
    )


def jaccard(a: Column, b: Column) -> Column:
    """Token sets of two names that are normalised already."""
    x, y = F.split(a, " "), F.split(b, " ")
    return F.size(F.array_intersect(x, y)).cast("double") / F.size(F.array_union(x, y))


def bigrams(c: Column) -> Column:
    compact = F.regexp_replace(c, r"\s+", "")
    # A sequence from 1 to 0 would run down, so short names are set apart.
    return F.when(F.length(compact) >= 2, F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(compact) - 1, F.lit(1))), lambda i: F.substring(compact, i, F.lit(2))
    )).otherwise(F.array().cast("array<string>"))


def occurrences(grams: Column, gram: Column) -> Column:
    return F.size(F.filter(grams, lambda g: g == gram))


def dice_of(x: Column, y: Column) -> Column:
    """Multiset overlap of two arrays of bigrams; 0 where either is empty."""
    shared = F.aggregate(
        F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(occurrences(x, g), occurrences(y, g)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(
        F.lit(2.0) * shared / (F.size(x) + F.size(y)))


def dice(a: Column, b: Column) -> Column:
    return dice_of(bigrams(a), bigrams(b))


def merchant_similarity(a: Column, b: Column) -> Column:
    return (
        F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0)
        .when(a == b, 1.0)
        .otherwise(F.lit(0.5) * jaccard(a, b) + F.lit(0.5) * dice(a, b))
    )


def score_merchant(a: Column, b: Column) -> Column:
    """The better of the names as written and in Latin letters; both are normalised already."""
    return round3(F.greatest(merchant_similarity(a, b), merchant_similarity(transliterate(a), transliterate(b))))


def tips(category: Column | str, merchant: Column | str) -> Column:
    """Whether a transaction is one of a place where tips are given."""
    where = F.upper(F.concat(F.coalesce(column(category), F.lit("")), F.lit(" "), column(merchant)))
    return where.rlike(f"RESTAURANT|{START}REST{END}|CAFE|COFFEE|HOTEL|HOSPITALITY|مطعم|مقهى")


def tip_eligible(document_type: Column, category: Column, merchant: Column) -> Column:
    return (document_type == "RECEIPT") & tips(category, merchant)


def rarity(frequency: Column) -> Column:
    return round3(F.lit(1.0) / F.sqrt(F.greatest(F.lit(1), frequency).cast("double")))


def present(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def received() -> Column:
    """Whether a document's date is that of its receipt."""
    return F.coalesce(F.col("doc_date_source") == "RECEIVED_AT", F.lit(False))


def weights() -> dict[str, Column]:
    """What each core signal of a document weighs: by its reliability, nothing where the document doesn't have it."""
    c = F.col
    reliability = {f: clamp01(F.coalesce(c(f"conf_{f}"), F.lit(1.0))) for f in ("amount", "date", "merchant", "card")}
    reliability["date"] = F.when(received(), F.least(clamp01(F.coalesce(c("conf_date"), F.lit(M.received_reliability))), F.lit(M.received_reliability))).otherwise(reliability["date"])
    weight = {"amount": M.weight_amount, "date": M.weight_date, "merchant": M.weight_merchant, "card": M.weight_card}
    return {n: F.when(has, F.lit(weight[n]) * reliability[n]).otherwise(0.0) for n, has in core_signals().items()}


def core_signals() -> dict[str, Column]:
    """Whether a document has each core signal."""
    c = F.col
    return {"amount": c("doc_amount").isNotNull(), "date": c("doc_date").isNotNull(), "merchant": present(c("doc_merchant")), "card": present(c("doc_card"))}


def available_signals() -> Column:
    return F.filter(F.array(*[F.when(has, F.lit(label)) for has, label in zip(core_signals().values(), CORE_SIGNALS, strict=True)]), lambda x: x.isNotNull())


def signal_bits() -> Column:
    """Which of ``core_signals`` a document has, a bit each."""
    return functools.reduce(lambda a, b: a + b, [F.when(has, 1 << i).otherwise(0) for i, has in enumerate(core_signals().values())])


def signals_of(bits: Column) -> Column:
    """``available_signals`` from ``signal_bits``."""
    every = [F.array(*[F.lit(label) for i, label in enumerate(CORE_SIGNALS) if n >> i & 1]).cast("array<string>") for n in range(1 << len(CORE_SIGNALS))]
    return F.element_at(F.array(*every), bits + 1)


def coverage(total: Column) -> Column:
    return round3(clamp01(total))


def hard(field: str) -> Column:
    """Whether a document's field is read well enough to contradict."""
    return clamp01(F.coalesce(F.col(f"conf_{field}"), F.lit(1.0))) >= M.hard_contradiction


def compared(side: str) -> dict[str, Column]:
    """The fields that are equal or not, as they are compared; null where there is none. A transaction's card is compared in any case."""
    c = lambda f: F.col(f"{side}_{f}")
    card = F.when(present(c("card")), normalize_digits(c("card"))) if side == "doc" else F.coalesce(normalize_digits(c("card")), F.lit(""))
    return {"currency": F.when(present(c("currency")), normalize_currency(c("currency"))), "card": card} | {
        f: F.when(present(c(f)), normalize_identifier(c(f))) for f in ("vat", "invoice", "auth")}


def named_signals(value: Callable[[str], Column], by_receipt: Column, contradictions: Column) -> Column:
    """The signals that are known, as entries; ``value`` gives a column of scores."""
    labels = [("amount", "amount"), ("date", "date"), ("merchant", "merchant"), ("card", "cardLast4"), ("vat", "vatNumber"), ("invoice", "invoiceNumber"), ("auth", "authorizationCode"), ("city", "merchantCity"), ("branch", "merchantBranch")]
    named = [F.struct(F.lit(label).alias("key"), round3(value(f"s_{n}")).alias("value")) for n, label in labels]
    alias = value("alias_score")
    named.append(F.struct(F.lit("dateFallback").alias("key"), F.when(by_receipt & value("s_date").isNotNull(), 1.0).alias("value")))
    named.append(F.struct(F.lit("merchantAlias").alias("key"), F.when((alias > 0) & value("s_merchant").isNotNull(), round3(alias)).alias("value")))
    named.append(F.struct(F.lit("currency").alias("key"), F.when(F.array_contains(contradictions, "currency_mismatch"), 0.0).alias("value")))
    named += [F.struct(F.lit(f"{n}Rarity").alias("key"), value(f"r_{n}").alias("value")) for n in ("merchant", "amount")]
    return F.filter(F.array(*named), lambda e: e["value"].isNotNull())


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Signals, contradictions, coverage and confidences of each pair.

    ``pairs`` has the document's columns (doc_*: type, amount, currency, date, date_source, card, vat, invoice, auth,
    conf_<field> reliabilities, null for unknown), the transaction's (tx_*: amount, currency, at, card, vat, invoice,
    auth, category, merchant), merchant_score of the normalised names, alias_score, cities and branches of both sides
    (doc_city, ...), and merchant_frequency and amount_frequency within the document's block.
    """
    c = F.col
    other_currency = F.coalesce(
        present(c("doc_currency")) & present(c("tx_currency")) & (normalize_currency("doc_currency") != normalize_currency("tx_currency")), F.lit(False))
    amount = F.when(c("doc_amount").isNotNull(), F.when(other_currency, 0.0).otherwise(clamp01(
        score_amount(c("doc_amount"), c("tx_amount"), tip_eligible(c("doc_type"), c("tx_category"), c("tx_merchant"))))))
    date = F.when(c("doc_date").isNotNull(), clamp01(score_date(c("doc_date"), c("tx_at"))))
    blended = F.greatest(c("merchant_score"), F.coalesce(c("alias_score"), F.lit(0.0)))
    city = F.when(c("doc_city").isNotNull() & c("tx_city").isNotNull(), (c("doc_city") == c("tx_city")).cast("double"))
    branch = F.when(c("doc_branch").isNotNull() & c("tx_branch").isNotNull(), (c("doc_branch") == c("tx_branch")).cast("double"))
    blended = F.when(city.isNull(), blended).otherwise(F.lit(0.85) * blended + F.lit(0.15) * city)
    merchant = F.when(present(c("doc_merchant")), clamp01(
        F.when(branch.isNull(), blended).otherwise(F.lit(0.9) * blended + F.lit(0.1) * branch)))
    card = F.when(present(c("doc_card")), (normalize_digits("doc_card") == F.coalesce(normalize_digits("tx_card"), F.lit(""))).cast("double"))

    signals = {"amount": amount, "date": date, "merchant": merchant, "card": card}
    with_signals = pairs.select("*", *[s.alias(f"s_{n}") for n, s in signals.items()], city.alias("s_city"), branch.alias("s_branch"))
    for name, field in (("vat", "vat"), ("invoice", "invoice"), ("auth", "auth")):
        both = present(c(f"doc_{field}")) & present(c(f"tx_{field}"))
        same = normalize_identifier(f"doc_{field}") == normalize_identifier(f"tx_{field}")
        with_signals = with_signals.withColumn(f"s_{name}", F.when(both, same.cast("double")))

    contradictions = F.filter(F.array(
        F.when(c("doc_amount").isNotNull() & other_currency & hard("currency"), F.lit("currency_mismatch")),
        F.when((c("s_card") == 0) & hard("card"), F.lit("card_last4_mismatch")),
        *[F.when((c(f"s_{n}") == 0) & hard(n), F.lit(f"{label}_mismatch")) for n, label in (("vat", "vatNumber"), ("invoice", "invoiceNumber"), ("auth", "authorizationCode"))],
    ), lambda x: x.isNotNull())

    weight = weights()
    total = weight["amount"] + weight["date"] + weight["merchant"] + weight["card"]
    earned = sum((F.coalesce(c(f"s_{n}"), F.lit(0.0)) * w for n, w in weight.items()), F.lit(0.0))
    summed = with_signals.select(
        "*", contradictions.alias("contradictions"), total.alias("w_total"), earned.alias("w_earned"),
        available_signals().alias("available_signals"),
        F.when((c("s_merchant") >= M.merchant_rarity_from) & (c("merchant_frequency") > 0), rarity(c("merchant_frequency"))).alias("r_merchant"),
        F.when((c("s_amount") >= M.amount_rarity_from) & (c("amount_frequency") > 0), rarity(c("amount_frequency"))).alias("r_amount"))

    base = F.when(c("w_total") > 0, c("w_earned") / c("w_total")).otherwise(0.0)
    strong = F.coalesce(F.greatest("s_vat", "s_invoice", "s_auth"), F.lit(0.0)) == 1
    base = F.when(strong & (base >= M.identifier_from), F.greatest(base, F.lit(M.identifier_floor))).otherwise(base)
    base = base + F.coalesce(F.lit(M.merchant_rarity) * c("r_merchant"), F.lit(0.0))
    base = base + F.coalesce(F.lit(M.amount_rarity) * c("r_amount"), F.lit(0.0))
    count = F.size("contradictions")
    base = F.when(count > 0, base * F.pow(F.lit(M.contradiction_factor), count)).otherwise(base)
    scored = summed.withColumn("raw_confidence", base).withColumn("evidence_coverage", coverage(c("w_total")))
    return scored.select(
        "*", round3(clamp01(c("raw_confidence"))).alias("confidence"),
        round3(clamp01(c("raw_confidence") * F.sqrt("evidence_coverage"))).alias("decision_confidence"),
        F.map_from_entries(named_signals(c, received(), c("contradictions"))).alias("signals"))
