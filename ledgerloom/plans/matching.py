"""From documents and ledger to scored pairs, outcomes and stored matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ledgerloom.constants import MATCHER as M
from ledgerloom.functions import scoring
from ledgerloom.functions.text import merchant_city, normalize_phone
from ledgerloom.operators import around, assignment, blocking, decision, pair_scores
from ledgerloom.plans import views
from ledgerloom.scratch import drop, written


def sides(docs: DataFrame, ledger: DataFrame, aliases: DataFrame | None = None, refused: DataFrame | None = None, doc: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Scoped documents, and the ledger under its scopes, with all that meeting and comparing them takes.

    Merchants are normalised once per distinct name. ``refused`` pairs (doc_id, tx_id) are left out. Of the documents'
    columns, only those that are compared and ``doc`` are carried along.
    """
    docs = docs.select(*[c for c in docs.columns if c in {"scope", *views.DOC_COLUMNS, *doc}])
    right = views.with_names(ledger.withColumn("has_confirmed_document", F.lit(False)) if "has_confirmed_document" not in ledger.columns else ledger, "tx")
    if "tx_city_name" in ledger.columns:
        # The city of the ledger's own column counts behind the one in the name.
        right = right.withColumn("tx_city", F.coalesce("tx_city", merchant_city(F.coalesce("tx_city_name", F.lit("")))))
    if aliases is not None:
        listed = blocking.attached_aliases(aliases).select("client_id", F.col("core").alias("tx_core"), "alias_cores")
        right = right.join(listed, ["client_id", "tx_core"], "left")
    own, known = blocking.blocks_of(docs, blocking.scoped_ledger(pair_scores.transactions(right)), aliases, refused)
    return pair_scores.documents(views.with_names(own, "doc")), known


def fields(rows: DataFrame, names: tuple[str, ...]) -> list[StructField]:
    return [StructField(c, rows.schema[c].dataType) for c in names]


def met(own: DataFrame, known: DataFrame, doc: tuple[str, ...], tx: tuple[str, ...], made: Callable, schema: StructType) -> DataFrame:
    left, right = [*dict.fromkeys([*doc, *pair_scores.OWN])], [*dict.fromkeys([*tx, *pair_scores.OTHER])]
    return around.met(blocking.gathered(own, left), known, M.block_cap, M.max_days, M.safety_days, [*map(F.col, left)], [*map(F.col, right)], made, schema)


def scored(docs: DataFrame, ledger: DataFrame, doc: tuple[str, ...] = (), scores: tuple[str, ...] = pair_scores.SCORES) -> DataFrame:
    """All candidates with their scores: doc_id, ``doc`` columns, tx_id, ``scores`` and the contradictions as ``flags``.

    They are scored where they are made, beside the other candidates of their document; no pair is moved or sorted.
    """
    own, known = sides(docs, ledger, doc=doc)
    doc, tx = ("doc_id", *doc), ("tx_id",)
    return met(own, known, doc, tx, *pair_scores.every_pair(fields(own, doc), fields(known, tx), scores))


def listed(
    docs: DataFrame, ledger: DataFrame, aliases: DataFrame | None = None, refused: DataFrame | None = None, doc: tuple[str, ...] = (), tx: tuple[str, ...] = (),
    scores: tuple[str, ...] = pair_scores.SCORES,
) -> DataFrame:
    """A row for each document with candidates: how many there are, the best score, and the best candidates with ``scores``.

    All candidates are scored; of each document only ``shown`` leaves the task that made them.
    """
    own, known = sides(docs, ledger, aliases, refused, doc)
    doc, tx = ("doc_id", "evidence_coverage", "signal_bits", "doc_date_source", *doc), ("tx_id", "has_confirmed_document", *tx)
    out = met(own, known, doc, tx, *pair_scores.best_pairs(fields(own, doc), fields(known, tx), M.top, M.display, scores))
    return out.withColumn("available_signals", scoring.signals_of(F.col("signal_bits"))).drop("signal_bits")


def scoped_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Receipts of good quality under their scope, the ledger under its scopes, and the ledger itself."""
    # Every block reads both: they are kept, and what an executor loses is computed anew.
    ledger = views.ledger(spark, sf_dir).persist()
    docs = views.receipts(spark, sf_dir).where(F.col("extraction_confidence") >= M.min_extraction)
    scoped = blocking.scoped_documents(docs, views.client_email(spark, sf_dir), ledger).persist()
    return scoped, blocking.scoped_ledger(ledger), ledger


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every receipt of the driver's tables."""
    docs, _, ledger = scoped_tables(spark, sf_dir)
    return decision.outcomes(docs.select("doc_id", "received_at").distinct(), listed(docs, ledger))


def match(docs: DataFrame, ledger: DataFrame, client_email: DataFrame, matches: DataFrame | None = None, aliases: DataFrame | None = None, audit_rate: float = M.audit_rate) -> DataFrame:
    """Documents (doc_id, source, sender_identifier, received_at, fields, reliabilities) with status and candidates.

    Documents of senders without a scope, and those without candidates, come back unmatched.
    """
    marked = blocking.confirmed_marks(ledger, matches) if matches is not None else ledger.withColumn("has_confirmed_document", F.lit(False))
    scoped_docs = blocking.scoped_documents(docs, client_email, marked)
    decided = decision.outcomes(docs.select("doc_id", "received_at"), listed(scoped_docs, marked, aliases))
    return decision.one_document_each(decided, audit_rate)


#: The scores that decide.
DECIDING = ("confidence", "decision_confidence")


def unmatched(docs: DataFrame, ledger: DataFrame, client_email: DataFrame) -> DataFrame:
    """``doc_id`` of the documents that ``match`` leaves unmatched; candidates aren't told of."""
    marked = ledger.withColumn("has_confirmed_document", F.lit(False))
    shown = listed(blocking.scoped_documents(docs, client_email, marked), marked, scores=DECIDING)
    return decision.outcomes(docs.select("doc_id"), shown, decision.plain).where("outcome = 'UNMATCHED'").select("doc_id")


def rematch_scope(documents: DataFrame, client_email: DataFrame, transactions: DataFrame) -> DataFrame:
    """The unmatched documents that new ``transactions`` may concern: of senders listed for their clients, or of their drivers' phones.

    No transactions, no documents. A sender set is the union of both, each sender once.
    """
    mails = client_email.join(transactions.select("client_id").distinct(), "client_id", "left_semi").select(F.lower("email").alias("_sender"))
    phones = transactions.where("driver_phone is not null").select(normalize_phone("driver_phone").alias("_sender"))
    senders = mails.unionByName(phones).distinct()
    own = F.when(F.col("source") == "WHATSAPP", normalize_phone("sender_identifier")).otherwise(F.lower("sender_identifier"))
    return documents.where("status = 'UNMATCHED'").withColumn("_sender", own).join(senders, "_sender", "left_semi").drop("_sender")


def rematched(unmatched: DataFrame, ledger: DataFrame, client_email: DataFrame, matches: DataFrame, aliases: DataFrame | None = None, told: bool = True) -> DataFrame:
    """Unmatched documents matched anew, with one transaction each: doc_id, status, status_reason, tx_id, score and the candidates.

    Candidates that a reviewer has rejected for a document stay out. Among all plausible candidates the assignment of
    the largest sum is taken; a document that loses its own best candidate, or gets none, goes to review. Unless they
    are ``told`` of, candidates have their transaction and score only.
    """
    # The ledger is read for its names, its windows and its identifiers: the matches are joined to it once, for all three.
    marked = written(blocking.confirmed_marks(ledger, matches), "marked")
    scoped_docs = blocking.scoped_documents(unmatched, client_email, marked)
    refused = matches.where("status = 'REJECTED'").select(F.col("document_id").alias("doc_id"), F.col("transaction_id").alias("tx_id")).distinct()
    # The assignment reads the decisions in rounds.
    shown = listed(scoped_docs, marked, aliases, refused, scores=pair_scores.SCORES if told else DECIDING)
    decided = written(decision.outcomes(unmatched.select("doc_id", "received_at"), shown, decision.entries if told else decision.plain), "decided")
    drop(marked)
    open_ = decided.where("outcome <> 'UNMATCHED'").select("doc_id", F.explode("candidates").alias("c"))
    chosen = assignment.assign(open_.select(F.col("doc_id").alias("document_id"), F.col("c.tx_id").alias("transaction_id"), F.col("c.decision_confidence").alias("score")))
    best = chosen.select(F.col("document_id").alias("doc_id"), F.col("transaction_id").alias("assigned"), "score")
    joined = decided.join(best, "doc_id", "left")
    safe = (F.col("outcome") == "AUTO_MATCHED") & (F.col("assigned") == F.col("tx_id"))
    return joined.select(
        "doc_id", F.when(F.col("outcome") == "UNMATCHED", "UNMATCHED").when(safe, "MATCHED").otherwise("NEEDS_REVIEW").alias("status"),
        F.when(F.col("outcome") == "UNMATCHED", F.col("reason")).when(safe, "AUTO_MATCHED_AFTER_REMATCH").otherwise("REMATCH_REVIEW").alias("status_reason"),
        F.coalesce("assigned", "tx_id").alias("tx_id"), F.coalesce("score", "top_score").alias("score"), "candidates")


def rematch(unmatched: DataFrame, ledger: DataFrame, client_email: DataFrame, matches: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``rematched`` without the candidates: ``(doc_id, status, status_reason, tx_id, score)``."""
    return rematched(unmatched, ledger, client_email, matches, aliases, told=False).drop("candidates")
