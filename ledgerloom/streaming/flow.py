"""The whole flow as streams: payloads to stored documents and matches, and transactions that come after their documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerloom.constants import MATCHER as M
from ledgerloom.operators import blocking
from ledgerloom.plans import ingestion, matching
from ledgerloom.plans.store import DOCUMENTS, Store
from ledgerloom.streaming.ingest import received_documents

#: The store of keyed state that timers and maps need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long an unmatched document waits for its transaction, in days after its receipt.
PATIENCE = 90


def started(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def start_ingestion(
    payloads: DataFrame, store: Store, checkpoint: str, extract: Callable[[DataFrame], DataFrame], client_email: DataFrame, ledger: Callable[[], DataFrame],
    media: DataFrame | None = None, aliases: DataFrame | None = None, audit_rate: float = M.audit_rate, once: bool = True) -> StreamingQuery:
    """From a stream of payloads ``(body)`` to stored documents with their status, their match rows, and rejected payloads.

    ``ledger`` is called for each batch, so that it is read as it stands then. Payloads sent again, in a batch or later,
    store nothing new.
    """

    def batch(rows: DataFrame, number: int) -> None:
        documents, rejected = received_documents(rows, media)
        before = ("ingest", number)
        final, found = ingestion.ingested(
            documents, extract, client_email, ledger(), stored=store.documents(before), matches=store.matches(before), aliases=aliases, audit_rate=audit_rate)
        store.save("matches", "ingest", number, found)
        store.save("rejected", "ingest", number, rejected)
        store.save("documents", "ingest", number, final)

    return started(payloads.writeStream.foreachBatch(batch), checkpoint, once)


class Waiting(StatefulProcessor):
    """Of one scope and step of time: the unmatched documents that wait there, and when a transaction last came in.

    Rows are ``(doc_id, at)``, without doc_id those of transactions; ids are strings, since pandas makes numbers with
    gaps inexact. A transaction calls all that wait; a document that
    comes after a transaction, but was received before, is called at once. A document waits until ``patience`` after its
    receipt; then a timer forgets it.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "doc_id string", "until long")
        self.arrived = handle.getValueState("arrived", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self.arrived.get()[0] if self.arrived.exists() else None
        called, came = set(), None
        for frame in rows:
            own = frame["doc_id"].isna()
            if own.any():
                came = max([*frame["at"][own].astype("int64"), *([came] if came is not None else [])])
            for doc_id, at in frame[~own][["doc_id", "at"]].itertuples(index=False):
                until = int(at) + self.patience_ms
                self.waiting.updateValue((doc_id,), (until,))
                self.handle.registerTimer(until)
                if last is not None and last >= at:
                    called.add(doc_id)
        if came is not None:
            self.arrived.update((max(came, last) if last is not None else int(came),))
            called.update(k[0] for k, _ in self.waiting.iterator())
        yield pd.DataFrame({"doc_id": pd.Series(sorted(called), dtype="object")})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for doc_id in [k[0] for k, (until,) in self.waiting.iterator() if until <= now]:
            self.waiting.removeKey((doc_id,))
        yield pd.DataFrame({"doc_id": pd.Series([], dtype="object")})

    def close(self) -> None:
        pass


def due_documents(unmatched: DataFrame, transactions: DataFrame, client_email: DataFrame, patience_days: int = PATIENCE, lateness: str = "7 days") -> DataFrame:
    """A stream of ``doc_id``: unmatched documents that transactions which came in later may concern.

    ``unmatched`` is a stream of documents (doc_id, source, sender_identifier, doc_date, received_at), ``transactions`` one
    of ledger rows with arrived_at. Both are dealt by scope and step of time, so a call reaches the documents of one
    client or driver whose window touches the transaction's month, and state is split the same way. State is bounded by
    the documents received within ``patience_days``; rows more than ``lateness`` behind the newest are dropped.
    """
    near = F.explode(blocking.date_steps(F.col("doc_date"), M.safety_days)).alias("step")
    asked = blocking.scoped_documents(unmatched, client_email, transactions).select("scope", near, F.col("doc_id").cast("string").alias("doc_id"), F.col("received_at").alias("event_at"))
    came = blocking.scoped_ledger(transactions).select("scope", blocking.date_step(F.col("tx_at")).alias("step"), F.lit(None).cast("string").alias("doc_id"), F.col("arrived_at").alias("event_at"))
    both = asked.unionByName(came).withWatermark("event_at", lateness).withColumn("at", F.unix_millis("event_at"))
    called = both.groupBy("scope", "step").transformWithStateInPandas(
        statefulProcessor=Waiting(patience_days * 86_400_000), outputStructType="doc_id string", outputMode="Append", timeMode="EventTime")
    return called.select(F.col("doc_id").cast("long").alias("doc_id"))


def start_rematching(
    spark: SparkSession, store: Store, transactions: DataFrame, checkpoint: str, client_email: DataFrame, ledger: Callable[[], DataFrame],
    aliases: DataFrame | None = None, patience_days: int = PATIENCE, once: bool = True) -> StreamingQuery:
    """Match stored unmatched documents anew when transactions come in after them, and store what comes of it.

    The stored documents and ``transactions`` (ledger rows with arrived_at) are read as streams. A batch takes the
    documents called that are still unmatched, with what was stored before it; running it again stores the same.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stored = spark.readStream.schema(DOCUMENTS).parquet(f"{store.folder}/documents/*/*").where("status = 'UNMATCHED'")
    due = due_documents(ingestion.matchable(stored), transactions, client_email, patience_days)

    def batch(rows: DataFrame, number: int) -> None:
        before = ("rematch", number)
        documents = store.documents(before).where("status = 'UNMATCHED'").join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
        found = matching.rematched(ingestion.matchable(documents), ledger(), client_email, store.matches(before), aliases).persist()
        each = found.where("status <> 'UNMATCHED'").select("doc_id", "status", F.col("tx_id").alias("chosen"), F.explode("candidates").alias("c"))
        chosen_first = Window.partitionBy("doc_id").orderBy(F.desc(F.coalesce(F.col("c.tx_id") == F.col("chosen"), F.lit(False))), "c.rank")
        kept = each.withColumn("place", F.row_number().over(chosen_first)).where("status = 'NEEDS_REVIEW' or place = 1")
        store.save("matches", "rematch", number, kept.select(
            F.col("doc_id").alias("document_id"), F.col("c.tx_id").alias("transaction_id"), "c.confidence", "c.decision_confidence", "c.evidence_coverage", "c.contradictions",
            F.col("place").alias("rank"), F.when(F.col("status") == "MATCHED", "AUTO_CONFIRMED").otherwise("CANDIDATE").alias("match_status"),
            F.when(F.col("status") == "MATCHED", "system-rematch").alias("decided_by"), F.lit(M.version).alias("matcher_version")))
        new = documents.drop("status", "status_reason", "tx_id").join(found.select("doc_id", "status", "status_reason", "tx_id"), "doc_id")
        store.save("documents", "rematch", number, new)
        found.unpersist()

    return started(due.writeStream.foreachBatch(batch), checkpoint, once)
