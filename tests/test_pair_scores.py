"""Scores made where candidates are made, against the column expressions over a table of pairs."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.constants import MATCHER as M
from ledgerloom.functions import scoring
from ledgerloom.operators import blocking, decision, pair_scores, review
from ledgerloom.plans import matching, views

START = dt.datetime(2025, 1, 1)
CONFS = [f"conf_{c}" for c in ("amount", "date", "merchant", "card", "currency", "vat", "invoice", "auth")]
DOC = "doc_id long, scope string, doc_date timestamp, doc_auth string, doc_invoice string, doc_vat string, doc_card string, doc_amount long, doc_merchant string, doc_type string, doc_currency string, doc_date_source string, " + ", ".join(f"{c} double" for c in CONFS)
TX = "tx_id long, client_id long, driver_phone string, tx_at timestamp, tx_auth string, tx_invoice string, tx_vat string, tx_card string, tx_amount long, tx_merchant string, tx_category string, tx_currency string, has_confirmed_document boolean"
NAMES = ["NANA BANANA CAFE ST 04 RUH", "Nana Bananas BR 12 JED", "مقهى نور", "NOUR MQHA", "Banana Nana Branch 4", "A", "12", "", None, "خبز شمس RUH", "KHBZ SHMS JED"]


def tables(seed, docs=60, ledger=200):
    rng = random.Random(seed)
    at = lambda: rng.choice([None, *[START + dt.timedelta(hours=7 * rng.randrange(200), milliseconds=rng.randrange(3)) for _ in range(9)]])
    value = lambda *few: rng.choice([None, "", *few])
    amount = lambda: rng.choice([None, 0, -500, 100, 1000, 1001, 1020, 900, 700, rng.randrange(1, 3000)])
    same = lambda: (value("a1", "a-1"), value("i1", "I 1", "i2"), value("v1", "V1"), value("1111", "x 11 11", "2222", "none"), amount(), rng.choice(NAMES))
    d = [(i, rng.choice(["c1", "c1", "c2", "p+9"]), at(), *same(), rng.choice([None, "RECEIPT", "TAX_INVOICE"]), value("SAR", " sar", "USD"), rng.choice([None, "RECEIVED_AT", "PRINTED", "PRINTED"]),
          *[rng.choice([None, 0.0, 0.5, 0.79, 0.8, 1.0, 1.5]) for _ in CONFS]) for i in range(docs)]
    t = [(i, rng.choice([1, 1, 2]), rng.choice([None, "+9"]), at(), *same(), value("CAFE", "FUEL"), value("SAR", "EUR"), rng.choice([None, True, False])) for i in range(ledger)]
    return d, t


def by_columns(docs, ledger, aliases, refused):
    """All pairs with their scores, by joins."""
    pairs = blocking.candidate_pairs(docs, blocking.scoped_ledger(ledger), aliases).join(refused, ["doc_id", "tx_id"], "left_anti")
    left, right = views.with_names(docs.drop("scope"), "doc"), views.with_names(ledger, "tx")
    named = pairs.join(left, "doc_id").join(right, "tx_id").withColumn("merchant_score", scoring.score_merchant(F.col("doc_core"), F.col("tx_core")))
    known = blocking.attached_aliases(aliases).select("client_id", F.col("core").alias("tx_core"), "alias_cores")
    each = F.transform(F.coalesce("alias_cores", F.array().cast("array<string>")), lambda a: scoring.score_merchant(F.col("doc_core"), a))
    return scoring.score_pairs(blocking.with_frequencies(named).join(known, ["client_id", "tx_core"], "left").withColumn("alias_score", F.array_max(each)))


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_are_those_of_the_columns(spark, seed):
    d, t = tables(seed)
    docs, ledger = spark.createDataFrame(d, DOC), spark.createDataFrame(t, TX)
    aliases = spark.createDataFrame(
        [(1, "NANA BANANA", "BAN", "NOUR MQHA", "NOUR MQHA"), (1, "NANA BANANA", "NAN", "مقهي نور", "KHBZ SHMS JED"), (2, "NOUR MQHA", "x", "NANA BANANA CAFE", "A")],
        "client_id long, canonical_normalized string, alias string, normalized_alias string, canonical_merchant_name string")
    refused = spark.createDataFrame([(i, x) for i in range(60) for x in range(i % 7, 200, 7)], "doc_id long, tx_id long")
    want = {(r.doc_id, r.tx_id): r for r in by_columns(docs, ledger, aliases, refused).collect()}
    got = {r.doc_id: r for r in decision.entries(matching.listed(docs, ledger, aliases, refused)).collect()}
    assert len(want) > 1000 and set(got) == {i for i, _ in want}
    for i, r in got.items():
        mine = [w for (j, _), w in want.items() if j == i]
        assert r.scoped == len(mine) and r.best == max(w.decision_confidence for w in mine)
        shown = sorted((w for w in mine if w.decision_confidence >= M.display), key=lambda w: (-w.decision_confidence, -w.confidence, w.tx_id))[: M.top]
        assert [c.tx_id for c in r.candidates] == [w.tx_id for w in shown]
        for c, w in zip(r.candidates, shown, strict=True):
            assert (c.confidence, c.decision_confidence, c.evidence_coverage, c.contradictions, c.available_signals) == (
                w.confidence, w.decision_confidence, w.evidence_coverage, w.contradictions, w.available_signals)
            assert {s.key: s.value for s in c.signals} == w.signals


def test_all_pairs_and_plan(spark):
    """Every pair is scored where it is made: nothing above the groups joins, sorts or shuffles."""
    d, t = tables(3)
    docs, ledger = spark.createDataFrame(d, DOC), spark.createDataFrame(t, TX)
    none = spark.createDataFrame([], "doc_id long, tx_id long")
    empty = spark.createDataFrame([], "client_id long, canonical_normalized string, alias string, normalized_alias string, canonical_merchant_name string")
    want = {(r.doc_id, r.tx_id, r.confidence, r.decision_confidence, r.s_merchant, *r.contradictions) for r in by_columns(docs, ledger, empty, none).collect()}
    pairs = matching.scored(docs, ledger)
    rows = pairs.withColumn("c", pair_scores.contradictions(F.col("flags"))).collect()
    assert {(r.doc_id, r.tx_id, r.confidence, r.decision_confidence, r.s_merchant, *r.c) for r in rows} == want and len(rows) == len(want)
    for frame in (pairs, matching.listed(docs, ledger)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("FlatMapGroupsInArrow")]
        assert not any(word in above for word in ("Exchange", "Sort", "Join"))
    assert matching.listed(docs.limit(0), ledger).count() == 0 and matching.listed(docs, ledger.limit(0)).count() == 0


def test_status_totals_match_once(spark):
    """What is counted is made once, not again for the share."""
    d, t = tables(4)
    decided = decision.outcomes(spark.createDataFrame(d, DOC).select("doc_id"), matching.listed(spark.createDataFrame(d, DOC), spark.createDataFrame(t, TX)))
    totals = review.status_totals(decided.select(F.when(F.col("outcome") == "AUTO_MATCHED", "MATCHED").otherwise(F.col("outcome")).alias("status")))
    assert totals._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
