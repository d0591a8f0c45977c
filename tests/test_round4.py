"""Scoring where candidates are made, with few shuffles before it and few columns on the way."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators import around, decision, pair_scores
from ledgerloom.plans import matching
from test_pair_scores import DOC, TX, tables


def test_documents_are_gathered_once_and_names_join_in_place(spark):
    """Documents aren't grouped anew for each use, nor either side moved to meet its names; what goes to the groups is a few arrays."""
    d, t = tables(5)
    pairs = matching.scored(spark.createDataFrame(d, DOC), spark.createDataFrame(t, TX))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "doc_merchant" not in plan
    assert plan.count("SortMergeJoin") <= 1  # identifiers that are asked for
    sent = plan[plan.index("meeting(") :]
    assert [c.split("#")[0].strip() for c in sent[len("meeting(") : sent.index(")")].split(",")] == ["key", "longs", "doubles", "texts", "mark"]


def test_decisions_without_what_is_told(spark):
    """Outcomes from transaction and score alone are those of all scores; so are the unmatched documents."""
    d, t = tables(6)
    docs, ledger = spark.createDataFrame(d, DOC), spark.createDataFrame(t, TX)
    every = docs.select("doc_id").distinct()
    full = decision.outcomes(every, matching.listed(docs, ledger))
    slim = decision.outcomes(every, matching.listed(docs, ledger, scores=matching.DECIDING), decision.plain)
    columns = [c for c in full.columns if c != "candidates"]
    rows = {r.doc_id: tuple(r) for r in full.select(*columns).collect()}
    assert {r.doc_id: tuple(r) for r in slim.select(*columns).collect()} == rows and len({r[1] for r in rows.values()}) > 1
    named = lambda frame: {r.doc_id: [(c.tx_id, c.decision_confidence) for c in r.candidates or []] for r in frame.collect()}
    assert named(full) == named(slim)


def test_counts_and_names_in_either_way():
    rng = np.random.default_rng(7)
    owner, code = np.sort(rng.integers(0, 9, 500)), rng.integers(0, 20, 500)
    times = Counter(zip(owner.tolist(), code.tolist(), strict=True))
    want = [times[x] for x in zip(owner.tolist(), code.tolist(), strict=True)]
    assert around.alike(owner, code).tolist() == want
    assert around.alike(owner, np.where(code == 0, 1 << 56, code)).tolist() == want  # too large to be packed
    assert around.alike(owner[:0], code[:0]).tolist() == [] and around.distinct(code[:0]).tolist() == []
    names = pair_scores.Names({"ALFA", "BRAVO ALFA", "", None, "نور", "NOUR"})
    a, b = rng.integers(0, len(names.empty), 60), rng.integers(0, len(names.empty), 60)
    score, rows = names.kept(a, b), np.arange(60)
    want = names.score(a, b).tolist()
    assert score(rows, rows).tolist() == want and score(rows[::-1], rows[::-1]).tolist() == want[::-1]


def test_rows_are_unpacked_as_they_were(spark):
    """Every kind of column, nulls among them, on either side."""
    docs = spark.sql("SELECT * FROM VALUES (1L, 'c1', timestamp'2025-01-01', 2, true, 1.5D, 'x', array('p', null), date'2025-01-01'), (2L, 'c1', null, null, null, null, null, null, null) AS t(doc_id, scope, doc_date, i, b, f, s, l, day)")
    ledger = spark.sql("SELECT 7L AS tx_id, 'c1' AS scope, timestamp'2025-01-02' AS tx_at, false AS flag, 'y' AS name")
    rows, parting = around.dealt(around.grouped(docs), ledger, 30, ["doc_id", "i", "b", "f", "s", "l", "day"], ["tx_id", "flag", F.col("name").alias("n")])
    found = [parting(iter(part.to_batches())) for part in (rows.where(F.col("key") == r.key).toArrow() for r in rows.select("key").distinct().collect())]
    own = sorted((r for o, _, _ in found for r in o.to_pylist()), key=lambda r: r["doc_id"])
    assert [tuple(r.values()) for r in own] == [tuple(r) for r in docs.orderBy("doc_id").select("doc_id", "i", "b", "f", "s", "l", "day").collect()]
    assert {tuple(r.values()) for _, near, _ in found for r in near.to_pylist()} == {(7, False, "y")} and all(len(m) == 0 for _, _, m in found)
