"""Reviewers' decisions: their fold into match states, learned aliases, histories and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.constants import MATCHER as M
from ledgerloom.functions.text import with_normalized
from ledgerloom.scratch import drop, written

#: Why a candidate was rejected.
REJECTIONS = {
    "NOT_SAME_PURCHASE": "Not the same purchase", "WRONG_AMOUNT": "Wrong amount", "WRONG_MERCHANT": "Wrong merchant", "WRONG_CARD": "Wrong card",
    "WRONG_DATE": "Wrong date", "DUPLICATE_TRANSACTION": "Transaction already used", "EXTRACTION_ERROR": "Receipt extraction is wrong"}
#: The match states that a document's status shows.
VISIBLE = [("NEEDS_REVIEW", "CANDIDATE"), ("MATCHED", "CONFIRMED"), ("MATCHED", "AUTO_CONFIRMED"), ("UNMATCHED", "REJECTED")]


def rejection_label(reason: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in REJECTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, reason), F.replace(F.lower(reason), F.lit("_"), F.lit(" ")))


def snapshots(matches: DataFrame) -> DataFrame:
    """``(document_id, candidate_snapshot)``: a document's matches as they stand, by rank and id."""
    entry = F.struct(F.coalesce("rank", F.lit(999)).alias("place"), "id", "transaction_id", "rank", "confidence", "decision_confidence", "evidence_coverage", "contradictions", "status")
    return matches.groupBy("document_id").agg(F.array_sort(F.collect_list(entry)).alias("candidate_snapshot"))


def snapshots_as_of(decisions: DataFrame, states: DataFrame) -> DataFrame:
    """``(decision_id, match_id, transaction_id, status)``: what a reviewer saw, each match of the document as it then stood.

    ``decisions`` are (id, document_id, decided_at), ``states`` the log of match states (match_id, document_id,
    transaction_id, status, changed_at, seq). What counts is the last state from before the decision, the largest seq of
    equal times; matches that had none yet aren't shown, and states that come in late count at their own time. A match's
    log and the decisions about it meet in one window: a document has few matches.
    """
    matches = states.select("match_id", "document_id", "transaction_id").distinct()
    asked = decisions.select(F.col("id").alias("decision_id"), "document_id", F.col("decided_at").alias("at")).join(matches, "document_id")
    log = states.select(F.lit(None).cast("long").alias("decision_id"), "match_id", "transaction_id", F.col("changed_at").alias("at"), "seq", "status")
    both = asked.select("decision_id", "match_id", "transaction_id", "at", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("status")).unionByName(log)
    # Of equal times decisions come first: a state of their own time isn't one from before.
    order = Window.partitionBy("match_id").orderBy("at", F.col("decision_id").isNull(), "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("status", F.last("status", ignorenulls=True).over(order)).where("decision_id is not null and status is not null").select(
        F.col("decision_id").cast("long").alias("decision_id"), "match_id", "transaction_id", "status")


def fold_decisions(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """``matches`` with the status after all decisions, and error of the last refused one.

    Decisions ``(match_id, action, decided_at, seq)`` apply in order. A confirmation needs an open candidate whose
    transaction no other document holds; it rejects the document's other candidates. A rejection needs an open
    candidate. Repeating a decision that stands does nothing.

    Decisions are taken in rounds of joins: in each, those that are the first left of their document, and confirmations
    only as the first left of their transaction too. No decision of a round bears on another one of it. There are as
    many rounds as the longest chain of decisions of which each waits for the one before; only documents that
    reviewers touched are gone through.
    """
    held = lambda rows: rows.where(F.col("status").isin("CONFIRMED", "AUTO_CONFIRMED")).select("transaction_id", "document_id")
    acts = decisions.select("match_id", "action", F.struct("decided_at", "seq", "match_id", "action").alias("place")).distinct()
    pending = written(acts.join(matches.select(F.col("id").alias("match_id"), "document_id", "transaction_id"), "match_id"), "decisions")
    touched = pending.select("document_id").distinct()
    before = written(held(matches).join(touched, "document_id", "left_anti"), "held")
    state = written(matches.join(touched, "document_id", "left_semi").select(
        "id", "document_id", "transaction_id", "status", F.lit(None).cast("string").alias("error")), "decided")
    confirms = F.col("action") == "CONFIRM"
    while not pending.isEmpty():
        of_document = pending.groupBy("document_id").agg(F.min("place").alias("first"))
        of_transaction = pending.where(confirms).groupBy("transaction_id").agg(F.min("place").alias("first_confirmed"))
        ready = (F.col("place") == F.col("first")) & (~confirms | (F.col("place") == F.col("first_confirmed")))
        marked = written(pending.join(of_document, "document_id").join(of_transaction, "transaction_id", "left").select(*pending.columns, ready.alias("ready")), "decisions")
        now = marked.where("ready").select("document_id", F.col("match_id").alias("acted"), F.when(confirms, "CONFIRMED").otherwise("REJECTED").alias("want"))
        holders = held(state).unionByName(before).groupBy("transaction_id").agg(F.min("document_id").alias("holder"))
        stands = (F.col("status") == F.col("want")) | ((F.col("status") == "AUTO_CONFIRMED") & (F.col("want") == "CONFIRMED"))
        taken = (F.col("want") == "CONFIRMED") & (F.col("holder") != F.col("document_id"))
        result = F.when(F.col("acted") == F.col("id"), F.when(stands, None).when(F.col("status") != "CANDIDATE", "NOT_OPEN").when(taken, "TRANSACTION_TAKEN").otherwise(F.col("want")))
        met = state.join(holders, "transaction_id", "left").join(now, "document_id", "left").withColumn("result", result)
        confirmed = F.coalesce(F.max(F.col("result") == "CONFIRMED").over(Window.partitionBy("document_id")), F.lit(False))
        step = written(met.withColumn("confirmed", confirmed).select(
            "id", "document_id", "transaction_id",
            F.when(F.col("result").isin("CONFIRMED", "REJECTED"), F.col("result"))
            .when(F.col("confirmed") & F.col("result").isNull() & (F.col("status") == "CANDIDATE"), "REJECTED").otherwise(F.col("status")).alias("status"),
            F.when(F.col("result").isin("NOT_OPEN", "TRANSACTION_TAKEN"), F.col("result")).otherwise(F.col("error")).alias("error")), "decided")
        left = written(marked.where("not ready").drop("ready"), "decisions")
        for old in (state, pending, marked):
            drop(old)
        state, pending = step, left
    folded = state.select("id", F.col("status").alias("folded"), "error")
    return matches.join(folded, "id", "left").withColumn("status", F.coalesce("folded", "status")).drop("folded")


def document_status(matches: DataFrame) -> DataFrame:
    """``(document_id, status, status_reason)`` of documents from their matches' states."""
    has = lambda s: F.max((F.col("status") == s).cast("int")) == 1
    return matches.groupBy("document_id").agg(
        F.when(has("CONFIRMED") | has("AUTO_CONFIRMED"), "MATCHED").when(has("CANDIDATE"), "NEEDS_REVIEW").otherwise("UNMATCHED").alias("status"),
        F.when(has("CONFIRMED"), "HUMAN_CONFIRMED").when(has("AUTO_CONFIRMED"), "AUTO_MATCHED").when(has("CANDIDATE"), "AMBIGUOUS_MATCH").otherwise("ALL_CANDIDATES_REJECTED").alias("status_reason"))


def candidate_counts(matches: DataFrame) -> DataFrame:
    """``(document_id, remaining, rejected)``: each document's open and rejected candidates."""
    return matches.groupBy("document_id").agg(
        F.count_if(F.col("status") == "CANDIDATE").alias("remaining"), F.count_if(F.col("status") == "REJECTED").alias("rejected"))


def highlighted(candidates: DataFrame) -> DataFrame:
    """Candidates with tied_for_best and recommended: those that share the best score, or the first if none does."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("decision_confidence"), "rank")
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best, second = F.first("decision_confidence").over(everyone), F.nth_value("decision_confidence", 2).over(everyone)
    tie = F.coalesce(best == second, F.lit(False))
    return candidates.withColumn("tied_for_best", tie & (F.col("decision_confidence") == best)).withColumn(
        "recommended", ~tie & (F.row_number().over(order) == 1))


def queue_with_matches(documents: DataFrame, matches: DataFrame) -> DataFrame:
    """The review queue as it is shown: documents under review, most urgent first, each with its open candidates.

    ``documents`` have id, status and received_at, ``matches`` the columns of stored matches.
    """
    open_ = visible_matches(documents.where("status = 'NEEDS_REVIEW'"), matches).withColumnRenamed("document_id", "doc_id")
    marked = highlighted(open_.withColumn("rank", F.coalesce("rank", F.lit(999))))
    entry = F.struct("rank", "id", "transaction_id", "confidence", "decision_confidence", "evidence_coverage", "contradictions", "tied_for_best", "recommended")
    listed = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("candidates"))
    received = documents.select(F.col("id").alias("doc_id"), "received_at")
    queue = review_queue(marked.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "id"))).join(received, "doc_id"))
    return queue.join(listed, "doc_id").orderBy(F.desc("priority"), F.desc("received_at"), "doc_id")


def learned_aliases(confirmations: DataFrame) -> DataFrame:
    """Aliases from confirmations ``(client_id, document_merchant, transaction_merchant, decided_at, id)``.

    One row per client, normalised alias and normalised merchant: how often, when last, and the last spellings. Names
    that normalise to nothing teach nothing.
    """
    named = with_normalized(with_normalized(confirmations, "document_merchant", "normalized_alias"), "transaction_merchant", "canonical_normalized")
    keyed = named.select(
        "client_id", "normalized_alias", "canonical_normalized",
        "document_merchant", "transaction_merchant", F.struct("decided_at", "id").alias("at"))
    known = keyed.where((F.coalesce("normalized_alias", F.lit("")) != "") & (F.coalesce("canonical_normalized", F.lit("")) != ""))
    return known.groupBy("client_id", "normalized_alias", "canonical_normalized").agg(
        F.max_by("document_merchant", "at").alias("alias"), F.max_by("transaction_merchant", "at").alias("canonical_merchant_name"),
        F.count("*").alias("confirmation_count"), F.max("at.decided_at").alias("last_confirmed_at"))


def review_queue(candidates: DataFrame) -> DataFrame:
    """``(doc_id, top, gap, priority)``, most urgent first: unsure scores, close runners-up and contradictions.

    ``candidates`` are ranked rows of documents under review, with received_at and contradictions.
    """
    order = Window.partitionBy("doc_id").orderBy("rank")
    first = candidates.withColumn("second", F.lead("decision_confidence").over(order)).where("rank = 1")
    gap = F.col("decision_confidence") - F.coalesce("second", F.lit(0.0))
    unsure = F.lit(1.0) - F.least(F.lit(1.0), F.abs(F.col("decision_confidence") - M.auto) / 0.27)
    priority = unsure + F.greatest(F.lit(0.0), F.lit(M.gap) - gap) / M.gap + F.lit(0.25) * F.size("contradictions")
    return first.select("doc_id", "received_at", F.col("decision_confidence").alias("top"), gap.alias("gap"), priority.alias("priority")).orderBy(
        F.desc("priority"), F.desc("received_at"), "doc_id")


def visible_matches(documents: DataFrame, matches: DataFrame) -> DataFrame:
    """The matches that a document's status shows."""
    shown = F.lit(False)
    for status, state in VISIBLE:
        shown = shown | ((F.col("doc_status") == status) & (F.col("status") == state))
    return documents.select(F.col("id").alias("document_id"), F.col("status").alias("doc_status")).join(matches, "document_id").where(shown)


def status_totals(documents: DataFrame) -> DataFrame:
    """``(status, n, matched_rate)``: documents of each status, and the whole percent matched of all."""
    each = documents.groupBy("status").agg(F.count("*").alias("n"))
    # A row for each status; summed again in one window, since a join of it with its own sum would make it twice.
    whole = Window.partitionBy(F.lit(0))
    matched = F.sum(F.when(F.col("status") == "MATCHED", F.col("n")).otherwise(0)).over(whole)
    return each.select("status", "n", F.floor(F.lit(100.0) * matched / F.sum("n").over(whole) + F.lit(0.5)).cast("long").alias("matched_rate"))


def newest_events(events: DataFrame, limit: int = 100) -> DataFrame:
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(200, limit)))


def history(events: DataFrame, documents: DataFrame, limit: int = 100) -> DataFrame:
    """The newest decisions, and the lifecycle rows of documents that none of them is about, newest first.

    A decision is shown as its snapshots have it, never as the ledger stands now.
    """
    newest = newest_events(events, limit)
    chosen = F.get(F.filter("candidate_snapshot", lambda c: c["transaction_id"] == F.col("transaction_id")), F.lit(0))
    decided = newest.select(
        F.lit("DECISION").alias("kind"), "document_id", "transaction_id", "action", rejection_label(F.col("reason")).alias("reason"),
        chosen["decision_confidence"].alias("decision_confidence"), F.col("created_at").alias("occurred_at"))
    rest = documents.join(newest.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti").where("status <> 'NEEDS_REVIEW'")
    lifecycle = rest.select(
        F.lit("LIFECYCLE").alias("kind"), F.col("id").alias("document_id"), F.col("status").alias("action"), F.col("updated_at").alias("occurred_at"))
    return decided.unionByName(lifecycle, allowMissingColumns=True).orderBy(F.desc("occurred_at"), F.desc("document_id"), "kind")
