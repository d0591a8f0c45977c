"""Decisions in any order of arrival, and what reviewers saw."""

from __future__ import annotations

import datetime as dt
import random

from ledgerloom.operators import review
from ledgerloom.streaming.decisions import DECISIONS, DecisionLog, start_decisions

NOON = dt.datetime(2025, 6, 1, 12)
MATCHES = "id long, document_id long, transaction_id long, status string"


def test_stream_of_decisions_equals_the_fold(spark, tmp_path):
    """Shuffled arrival in four batches; the last, of a day later, closes all others. One decision comes too late."""
    rng = random.Random(6)
    matches = spark.createDataFrame([(d * 10 + k, d, 100 + (d + k) % 5, "AUTO_CONFIRMED" if d == 7 and k == 0 else "CANDIDATE") for d in range(8) for k in range(3)], MATCHES)
    acts = [(d * 10 + k, rng.choice(["CONFIRM", "CONFIRM", "REJECT"]), NOON + dt.timedelta(minutes=rng.randrange(30)), s) for s, (d, k) in enumerate((rng.randrange(8), rng.randrange(3)) for _ in range(30))]
    closing, late = (71, "REJECT", NOON + dt.timedelta(days=1), 99), (11, "REJECT", NOON, 98)
    rng.shuffle(acts)
    log = DecisionLog(spark, f"{tmp_path}/log", lambda: matches, lateness="2 hours")
    for number, rows in enumerate([acts[:12], acts[12:], [closing], [late]]):
        spark.createDataFrame(rows, DECISIONS).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
        start_decisions(spark.readStream.schema(DECISIONS).parquet(f"{tmp_path}/in/*"), log, f"{tmp_path}/point").awaitTermination()
        if number == 1:
            assert {r.error for r in log.states().collect()} == {None}  # nothing is closed yet
    want = {(r.id, r.status, r.error) for r in review.fold_decisions(matches, spark.createDataFrame(acts, DECISIONS)).collect()}
    assert {(r.id, r.status, r.error) for r in log.states().collect()} == want
    assert [r.seq for r in log.table("late").collect()] == [98] and log.table("log").count() == 31
    assert any(e for _, _, e in want) and any(s == "CONFIRMED" for _, s, _ in want)


def test_decisions_closed_in_turns_equal_the_fold(spark, tmp_path):
    """Each batch closes the one before, so states and holders carry over from batch to batch."""
    matches = spark.createDataFrame([(1, 1, 9, "CANDIDATE"), (2, 1, 8, "CANDIDATE"), (3, 2, 9, "CANDIDATE"), (4, 3, 8, "CANDIDATE"), (5, 3, 7, "CANDIDATE")], MATCHES)
    days = [[(1, "CONFIRM", 0, 1)], [(3, "CONFIRM", 1, 2)], [(4, "CONFIRM", 2, 3), (2, "CONFIRM", 2, 4)], [(3, "REJECT", 3, 5)], [(5, "CONFIRM", 4, 6)]]
    acts = [[(m, a, NOON + dt.timedelta(days=d), s) for m, a, d, s in rows] for rows in days]
    log = DecisionLog(spark, f"{tmp_path}/log", lambda: matches)
    for number, rows in enumerate(acts):
        log.batch(spark.createDataFrame(rows, DECISIONS), number)
        log.batch(spark.createDataFrame(rows, DECISIONS), number)  # again, as after a failure
    want = {(r.id, r.status, r.error) for r in review.fold_decisions(matches, spark.createDataFrame(sum(acts[:-1], []), DECISIONS)).collect()}
    assert {(r.id, r.status, r.error) for r in log.states().collect()} == want
    assert {(i, e) for i, _, e in want if e} == {(3, "TRANSACTION_TAKEN"), (2, "NOT_OPEN")}


def test_snapshots_as_of(spark):
    at = lambda h: NOON + dt.timedelta(hours=h)
    states = [(1, 5, 50, "CANDIDATE", at(0), 1), (1, 5, 50, "REJECTED", at(2), 2), (1, 5, 50, "CANDIDATE", at(2), 3), (1, 5, 50, "CONFIRMED", at(4), 4), (2, 5, 60, "CANDIDATE", at(3), 5), (3, 6, 70, "CANDIDATE", at(1), 6)]
    rng = random.Random(1)
    rng.shuffle(states)
    decisions = [(10, 5, at(0)), (11, 5, at(1)), (12, 5, at(3)), (13, 5, at(9)), (14, 7, at(9))]
    got = review.snapshots_as_of(
        spark.createDataFrame(decisions, "id long, document_id long, decided_at timestamp"), spark.createDataFrame(states, "match_id long, document_id long, transaction_id long, status string, changed_at timestamp, seq long")).collect()
    assert {(r.decision_id, r.match_id, r.status) for r in got} == {(11, 1, "CANDIDATE"), (12, 1, "CANDIDATE"), (13, 1, "CONFIRMED"), (13, 2, "CANDIDATE")}
