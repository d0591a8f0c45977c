"""Ranking, gates and outcomes of scored pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.constants import MATCHER as M
from ledgerloom.functions import scoring
from ledgerloom.operators import pair_scores


def entries(listed: DataFrame) -> DataFrame:
    """``listed`` documents with their ``shown`` candidates as they are told of: rank, scores, signals, contradictions."""
    def told(c: Column, i: Column) -> Column:
        contradictions = pair_scores.contradictions(c["flags"])
        return F.struct(
            (i + 1).cast("int").alias("rank"), *[c[f].alias(f) for f in ("tx_id", "confidence", "decision_confidence")], F.col("evidence_coverage"),
            scoring.named_signals(lambda f: c[f], scoring.received(), contradictions).alias("signals"), contradictions.alias("contradictions"), F.col("available_signals"))
    return listed.withColumn("candidates", F.transform("shown", told))


def plain(listed: DataFrame) -> DataFrame:
    """``listed`` documents with transaction and score of their ``shown`` candidates, where nobody is told of more."""
    return listed.withColumn("candidates", F.transform("shown", lambda c: F.struct(c["tx_id"].alias("tx_id"), c["decision_confidence"].alias("decision_confidence"))))


def ranked(listed: DataFrame) -> DataFrame:
    """The best candidates of each document at or above the display floor, a row each: rank, scores, and ``gap``, the distance to the next.

    The last one's distance is its own score.
    """
    following = F.get("shown", F.col("pos") + 1)["decision_confidence"]
    return listed.select("*", F.posexplode("shown").alias("pos", "c")).withColumn("gap", F.col("c.decision_confidence") - F.coalesce(following, F.lit(0.0))).withColumn(
        "rank", F.col("pos") + 1).select(*[c for c in listed.columns if c != "shown"], "rank", "gap", "c.*")


def safe_gate(first: Column) -> Column:
    """Whether a document's first candidate by itself may be matched automatically; the distance to the next comes beside it."""
    return (
        (first["decision_confidence"] >= M.auto) & (F.col("evidence_coverage") >= M.min_coverage) & (F.size("available_signals") >= M.min_signals) & ~scoring.received()
        & (first["flags"] == 0) & ~F.coalesce(first["has_confirmed_document"], F.lit(False)))


def outcomes(docs: DataFrame, listed: DataFrame, told: Callable[[DataFrame], DataFrame] = entries) -> DataFrame:
    """One row per document: outcome, reason, counts, top candidate and the ranked list.

    Every document of ``docs`` comes back, also those without any candidate. ``listed`` are ``matching.listed``.
    """
    at = lambda i: F.get("shown", F.lit(i))
    known = told(listed).select(
        "doc_id", "scoped", "best", "candidates", safe_gate(at(0)).alias("safe"), F.size("shown").alias("displayed"),
        at(0)["tx_id"].alias("first"), at(0)["decision_confidence"].alias("top"), at(1)["decision_confidence"].alias("second"))
    joined = docs.join(known, "doc_id", "left")
    top = F.col("top")
    gap = top - F.coalesce("second", F.lit(0.0))
    reason = (
        F.when(F.col("scoped").isNull(), "NO_SCOPED_TRANSACTIONS").when(top.isNull(), "NO_CANDIDATE_ABOVE_DISPLAY_THRESHOLD")
        .when(top < M.review, "TOP_SCORE_BELOW_REVIEW_THRESHOLD"))
    outcome = F.when(reason.isNotNull(), "UNMATCHED").when(F.col("safe") & (gap >= M.gap), "AUTO_MATCHED").otherwise("NEEDS_REVIEW")
    return joined.select(
        *docs.columns, outcome.alias("outcome"), reason.alias("reason"), F.coalesce("scoped", F.lit(0)).cast("long").alias("scoped_candidate_count"),
        F.greatest(F.coalesce("displayed", F.lit(0)), F.lit(0)).cast("long").alias("displayed_candidate_count"), F.coalesce(top, F.col("best")).alias("top_score"),
        F.when(outcome != "UNMATCHED", F.col("first")).alias("tx_id"), F.when(outcome != "UNMATCHED", gap).alias("gap"),
        F.when(outcome != "UNMATCHED", F.col("candidates")).alias("candidates"))


def audit_sampled(key: Column, rate: float = M.audit_rate) -> Column:
    """Whether the first four bytes of the key's sha256, as a part of all they can be, lie below ``rate``."""
    if rate <= 0 or rate >= 1:
        return F.lit(rate >= 1)
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) < rate


def one_document_each(decided: DataFrame, audit_rate: float = M.audit_rate) -> DataFrame:
    """Final status of documents in order of arrival: of those that would match a transaction by themselves, the first
    outside the audit sample gets it; the others need review.

    Equal to deciding one document after the other, since scores don't depend on other documents.
    """
    audited = (F.col("outcome") == "AUTO_MATCHED") & audit_sampled(F.col("doc_id"), audit_rate)
    marked = decided.withColumn("audited", audited).withColumn("claims", (F.col("outcome") == "AUTO_MATCHED") & ~audited)
    first = Window.partitionBy("tx_id", "claims").orderBy("received_at", "doc_id")
    wins = F.col("claims") & (F.row_number().over(first) == 1)
    final = F.when(wins, "MATCHED").when(F.col("outcome") == "UNMATCHED", "UNMATCHED").otherwise("NEEDS_REVIEW")
    return marked.withColumn("status", final).withColumn(
        "status_reason", F.when(wins, "AUTO_MATCHED").when(F.col("audited"), "AUTO_MATCH_AUDIT").when(F.col("outcome") == "UNMATCHED", F.col("reason")).otherwise("AMBIGUOUS_MATCH")
    ).drop("claims")


def match_rows(final: DataFrame) -> DataFrame:
    """The match rows to store: the winner of a matched document, all candidates of one under review."""
    each = final.where("status <> 'UNMATCHED'").select("doc_id", "status", F.explode("candidates").alias("c"))
    kept = each.where((F.col("status") == "NEEDS_REVIEW") | (F.col("c.rank") == 1))
    return kept.select(
        F.col("doc_id").alias("document_id"), F.col("c.tx_id").alias("transaction_id"), "c.confidence", "c.decision_confidence", "c.evidence_coverage",
        "c.contradictions", "c.rank", F.when(F.col("status") == "MATCHED", "AUTO_CONFIRMED").otherwise("CANDIDATE").alias("match_status"),
        F.when(F.col("status") == "MATCHED", "system").alias("decided_by"), F.lit(M.version).alias("matcher_version"))
