"""Explanations in words: document status, review triggers, candidates field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.constants import CORE_SIGNALS
from ledgerloom.constants import MATCHER as M
from ledgerloom.functions.text import format_money, percent, round3

PROMPT_VERSION = "match-explanation-v2"

#: Title and description of each reason; None where an error message stands before the description.
STATUS_TEXTS = [
    ("AUTO_MATCHED", "Matched automatically", "The top candidate passed every score, evidence, ambiguity, and contradiction safety gate.", False),
    ("HUMAN_CONFIRMED", "Confirmed by a reviewer", "A finance reviewer selected the transaction after comparing the extracted document with its candidates.", False),
    ("AUTO_MATCHED_AFTER_REMATCH", "Matched after a late transaction arrived", "The document was previously unmatched, then rematching found a safe transaction after the ledger changed.", False),
    ("AMBIGUOUS_MATCH", "Sent to review because the decision was ambiguous", "At least one plausible candidate existed, but one or more automatic-match safety gates did not pass.", False),
    ("AUTO_MATCH_AUDIT", "Selected for a quality audit", "The engine found an automatic match, but the configured audit sample intentionally requested human verification.", False),
    ("REMATCH_REVIEW", "A late candidate needs review", "Rematching found a plausible transaction, but it was not safe enough to attach automatically.", False),
    ("NO_SCOPED_TRANSACTIONS", "No authorized transaction was available", "No transaction existed inside the sender’s client/driver scope and applicable date window.", False),
    ("NO_CANDIDATE_ABOVE_DISPLAY_THRESHOLD", "Every candidate was implausible", "Transactions were available, but even the strongest score was below the minimum candidate display threshold.", False),
    ("TOP_SCORE_BELOW_REVIEW_THRESHOLD", "The best candidate was too weak", "The strongest candidate was visible to the matcher but did not reach the minimum score required for human review.", False),
    ("ALL_CANDIDATES_REJECTED", "All candidates were rejected", "A reviewer rejected every proposed transaction, so the document moved from review to unmatched.", False),
    ("EXTRACTION_ERROR", "Document extraction failed", "The extractor could not return structured receipt fields.", True),
    ("LOW_QUALITY_EXTRACTION", "Extraction quality was too low", "The extracted evidence was incomplete or unreliable, so matching was skipped.", True),
    ("CANDIDATE_SCOPING_ERROR", "Candidate loading failed", "The system could not safely load the authorized transaction scope.", True),
    ("PIPELINE_ERROR", "The ingestion pipeline failed", "An unexpected error occurred after the document was received.", True),
    ("LEGACY_MATCHED", "Matched before outcome diagnostics were enabled", "The relationship is confirmed, but this older record does not contain a detailed reason.", False),
    ("LEGACY_UNMATCHED", "Unmatched before outcome diagnostics were enabled", "This older record has no persisted scoring reason. Re-seed or rematch it to generate diagnostics.", False),
    ("LEGACY_FAILED", "Failed before outcome diagnostics were enabled", "This older failure has no structured stage diagnostic.", True),
]
#: What stands where no reason is known, by status.
FALLBACKS = [
    ("FAILED", "Processing failed", "No structured failure reason was stored.", True),
    ("UNMATCHED", "No match was confirmed", "No plausible transaction is currently attached to this document.", False),
    ("MATCHED", "Match confirmed", "This document is attached to a transaction.", False),
]
#: Facts of the diagnostics, in order, and whether they are shares.
FACTS = [
    ("topScore", "Best score", True), ("reviewThreshold", "Review floor", True), ("displayThreshold", "Candidate floor", True),
    ("scopedCandidateCount", "Transactions checked", False), ("rejectedCandidateCount", "Candidates rejected", False), ("extractionConfidence", "Extraction confidence", True)]
DETAILS = "struct<topScore:double,reviewThreshold:double,displayThreshold:double,scopedCandidateCount:bigint,rejectedCandidateCount:bigint,extractionConfidence:double>"
#: Words for signals and contradictions.
SIGNAL_LABELS = {
    "cardLast4": "card", "vatNumber": "VAT number", "invoiceNumber": "invoice number", "authorizationCode": "authorization code", "merchantCity": "city", "merchantBranch": "branch"}
CONTRADICTION_LABELS = {
    "currency_mismatch": "the currency", "card_last4_mismatch": "the card digits", "vatNumber_mismatch": "the VAT number",
    "invoiceNumber_mismatch": "the invoice number", "authorizationCode_mismatch": "the authorization code"}


def _cases(on: Column, values: list[tuple[str, Column]], otherwise: Column) -> Column:
    out = None
    for name, value in values:
        out = F.when(on == name, value) if out is None else out.when(on == name, value)
    return out.otherwise(otherwise)


def status_details(*pairs: tuple[str, Column]) -> Column:
    """Diagnostics as JSON; null where none is known."""
    text = F.to_json(F.struct(*[value.alias(name) for name, value in pairs]))
    return F.nullif(text, F.lit("{}"))


def diagnostic_facts(details: Column) -> Column:
    value = F.from_json(details, DETAILS)
    return F.filter(F.array(*[
        F.when(value[key].isNotNull(), F.concat(F.lit(f"{words}: "), percent(value[key]) if share else value[key].cast("string")))
        for key, words, share in FACTS]), lambda x: x.isNotNull())


def explained_status(documents: DataFrame) -> DataFrame:
    """``documents`` with title, description and facts of their status."""
    reason = F.coalesce("status_reason", "review_reason")
    text = lambda words, message: F.coalesce("error_message", F.lit(words)) if message else F.lit(words)
    fallback_title = _cases(F.col("status"), [(s, F.lit(t)) for s, t, _, _ in FALLBACKS], F.lit("Lifecycle outcome"))
    fallback_text = _cases(F.col("status"), [(s, text(d, m)) for s, _, d, m in FALLBACKS], F.lit("No additional outcome diagnostic was stored."))
    return documents.withColumn("title", _cases(reason, [(r, F.lit(t)) for r, t, _, _ in STATUS_TEXTS], fallback_title)).withColumn(
        "description", _cases(reason, [(r, text(d, m)) for r, _, d, m in STATUS_TEXTS], fallback_text)).withColumn("facts", diagnostic_facts(F.col("status_details")))


def legacy_reason(status: Column, reason: Column) -> Column:
    """The reason of rows from before reasons were kept."""
    return F.coalesce(reason, F.when(status == "MATCHED", "LEGACY_MATCHED").when(status == "UNMATCHED", "LEGACY_UNMATCHED").when(status == "FAILED", "LEGACY_FAILED").when(status == "NEEDS_REVIEW", "AMBIGUOUS_MATCH"))


def legacy_decision_confidence(confidence: Column, coverage: Column) -> Column:
    return confidence * (F.lit(0.5) + F.lit(0.5) * coverage)


def review_triggers(candidates: DataFrame) -> DataFrame:
    """Candidates with position, candidate_count, top_gap and triggers, from their siblings of one document.

    ``candidates`` are open matches with doc_id, match_id, rank, decision_confidence, evidence_coverage, signals (map),
    contradictions, has_confirmed_document, has_date and review_reason.
    """
    order = Window.partitionBy("doc_id").orderBy(F.desc("decision_confidence"), F.coalesce("rank", F.lit(2147483647)), "match_id")
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = candidates.withColumn("position", F.row_number().over(order)).withColumn("candidate_count", F.count("*").over(everyone)).withColumn(
        "best", F.first("decision_confidence").over(everyone)).withColumn("second", F.nth_value("decision_confidence", 2).over(everyone))
    top_gap = F.when(F.col("candidate_count") > 1, F.col("best") - F.col("second"))
    core = F.size(F.filter(F.array(*[F.lit(s) for s in CORE_SIGNALS]), lambda s: F.map_contains_key("signals", s)))
    triggers = [
        ("TRANSACTION_ALREADY_CONFIRMED", F.col("has_confirmed_document")),
        ("TOP_CANDIDATES_TOO_CLOSE", (F.col("best") == F.col("decision_confidence")) & (top_gap < M.gap)),
        ("RECEIVED_DATE_FALLBACK", ~F.col("has_date") | (F.coalesce(F.try_element_at("signals", F.lit("dateFallback")), F.lit(0.0)) == 1)),
        ("LOW_EVIDENCE", F.col("evidence_coverage") < M.min_coverage), ("TOO_FEW_SIGNALS", core < M.min_signals),
        ("CONTRADICTION", F.size("contradictions") > 0), ("BELOW_AUTO_THRESHOLD", F.col("decision_confidence") < M.auto),
        ("LOWER_RANKED", F.col("position") > 1), ("AUDIT_SAMPLE", F.coalesce(F.col("review_reason") == "AUTO_MATCH_AUDIT", F.lit(False)))]
    listed = F.filter(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.lit(name)) for name, on in triggers]), lambda x: x.isNotNull())
    return placed.withColumn("top_gap", round3(top_gap)).withColumn("triggers", listed).drop("best", "second")


def listed(words: Column) -> Column:
    """Words as in a sentence: a, b, and c."""
    return (
        F.when(F.size(words) == 0, "limited evidence").when(F.size(words) == 1, F.get(words, F.lit(0)))
        .when(F.size(words) == 2, F.array_join(words, " and "))
        .otherwise(F.concat(F.array_join(F.slice(words, 1, F.size(words) - 1), ", "), F.lit(", and "), F.element_at(words, -1))))


def _labels(names: Column, known: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.transform(names, lambda n: F.coalesce(F.try_element_at(table, n), F.replace(n, F.lit("_"), F.lit(" "))))


def local_explanation(rows: DataFrame) -> DataFrame:
    """Rows of ``review_triggers`` with explanation: the first template whose trigger holds."""
    entries = F.array_sort(F.map_entries("signals"))
    agree = F.transform(F.filter(entries, lambda e: (e["value"] >= 0.8) & (e["key"] != "dateFallback")), lambda e: e["key"])
    differ = F.transform(F.filter(entries, lambda e: (e["value"] <= 0.2) & (e["key"] != "dateFallback")), lambda e: e["key"])
    worded = rows.withColumn("_agree", agree).withColumn("_differ", differ)
    decision = percent(F.col("decision_confidence"))
    evidence = F.when(F.size("_agree") > 0, F.concat(
        listed(_labels(F.slice("_agree", 1, 4), SIGNAL_LABELS)), F.when(F.size("_agree") == 1, " supports").otherwise(" support"), F.lit(" this candidate"))).otherwise(
        F.concat(F.lit("This candidate has "), percent(F.col("confidence")), F.lit(" similarity and "), decision, F.lit(" decision confidence")))
    capital = F.concat(F.upper(F.substring(evidence, 1, 1)), F.expr("substring(_evidence, 2)"))
    worded = worded.withColumn("_evidence", evidence)
    capital = F.concat(F.upper(F.substring("_evidence", 1, 1)), F.substring(F.col("_evidence"), 2, 1000))
    has = lambda t: F.array_contains("triggers", t)
    against = listed(_labels(F.array_sort("contradictions"), CONTRADICTION_LABELS))
    mismatch = F.when(F.size("_differ") > 0, F.concat(F.lit("; "), listed(_labels(F.slice("_differ", 1, 3), SIGNAL_LABELS)), F.lit(" do not align"))).otherwise("")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    text = (
        F.when(has("TRANSACTION_ALREADY_CONFIRMED"), say(capital, ". Review is required because this transaction already has a confirmed document."))
        .when(has("TOP_CANDIDATES_TOO_CLOSE"), say(capital, ", but another candidate has nearly the same score. Check the receipt details before choosing."))
        .when(has("RECEIVED_DATE_FALLBACK"), say(capital, ". Review is required because the receipt has no reliable printed date, so its received date was used."))
        .when(has("CONTRADICTION"), say(capital, ", but ", against, F.when(F.size("contradictions") == 1, " conflicts").otherwise(" conflict"), " with the receipt."))
        .when(has("LOWER_RANKED"), say("This is candidate ", F.col("position").cast("string"), " of ", F.col("candidate_count").cast("string"), " with ", decision, " decision confidence", mismatch, ". Compare it with the higher-ranked option before matching."))
        .when(has("LOW_EVIDENCE") | has("TOO_FEW_SIGNALS"), say(capital, ", but only ", percent(F.col("evidence_coverage")), " of the expected evidence is available. More receipt detail is needed before matching."))
        .when(has("BELOW_AUTO_THRESHOLD"), say(capital, ", but the ", decision, " decision confidence is below the automatic-match threshold. A reviewer must confirm or reject it."))
        .when(has("AUDIT_SAMPLE"), say(capital, ". This strong candidate was intentionally sampled for a human quality audit."))
        .otherwise(say(capital, ". A reviewer should verify the receipt before making the final decision.")))
    return worded.withColumn("explanation", text).drop("_agree", "_differ", "_evidence")


def input_hash(rows: DataFrame) -> DataFrame:
    """Rows with input_hash: what an explanation is kept under, of its version and all that it is made from."""
    body = F.to_json(F.struct(
        "confidence", "decision_confidence", "position", "candidate_count", "top_gap", "evidence_coverage", F.array_sort(F.map_entries("signals")).alias("signals"),
        F.array_sort("contradictions").alias("contradictions"), "triggers"))
    return rows.withColumn("input_hash", F.sha2(F.concat(F.lit(f"{PROMPT_VERSION}:"), body), 256))


def explained(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows with explanation and cached: a kept text where match, hash and version are the same, else the local one."""
    kept = cache.select("match_id", "input_hash", F.col("prompt_version").alias("_version"), F.col("explanation").alias("_text"))
    fresh = local_explanation(input_hash(rows))
    joined = fresh.join(kept.where(F.col("_version") == PROMPT_VERSION), ["match_id", "input_hash"], "left")
    return joined.withColumn("cached", F.col("_text").isNotNull()).withColumn("explanation", F.coalesce("_text", "explanation")).drop("_version", "_text")


def clean_generated(text: Column) -> Column:
    """A generated text in one line without outer quotes; null unless it has 20 to 360 characters."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^['\"]|['\"]$", ""))
    return F.when(F.length(plain).between(20, 360), plain)


def comparison_rows(candidates: DataFrame) -> DataFrame:
    """``(doc_id, tx_id, field, receipt, ledger, score)``: four fields of every candidate, identifiers where either side has one."""
    c = F.col
    date = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm")
    fields = [
        ("amount", format_money(c("doc_amount"), c("doc_currency")), format_money(c("tx_amount"), c("tx_currency")), c("s_amount"), True),
        ("date", date(c("doc_date")), date(c("tx_at")), c("s_date"), True), ("merchant", c("doc_merchant"), c("tx_merchant"), c("s_merchant"), True),
        ("card", c("doc_card"), c("tx_card"), c("s_card"), True), ("vatNumber", c("doc_vat"), c("tx_vat"), c("s_vat"), False),
        ("invoiceNumber", c("doc_invoice"), c("tx_invoice"), c("s_invoice"), False), ("authorizationCode", c("doc_auth"), c("tx_auth"), c("s_auth"), False)]
    entry = [F.struct(F.lit(n).alias("field"), r.cast("string").alias("receipt"), t.cast("string").alias("ledger"), s.alias("score"), F.lit(always).alias("always")) for n, r, t, s, always in fields]
    rows = candidates.select("doc_id", "tx_id", F.inline(F.array(*entry)))
    return rows.where(c("always") | c("receipt").isNotNull() | c("ledger").isNotNull()).drop("always")
