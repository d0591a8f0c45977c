"""Explanations on demand: failures, deadlines, another try, and the cache."""

from __future__ import annotations

import json
import os
import time
import uuid

from ledgerloom.operators import generate

SCORES = {1: 0.81, 2: 0.72, 3: 0.63, 4: 0.59, 5: 0.58}


def candidates(spark, changed=None):
    rows = [(10, m, m, s, s + (0.001 if m == changed else 0), 0.8, {"amount": 1.0, "date": 0.1}, ["currency_mismatch"] if m == 3 else [], False, True, "AMBIGUOUS_MATCH") for m, s in SCORES.items()]
    return spark.createDataFrame(
        rows, "doc_id long, match_id long, rank int, confidence double, decision_confidence double, evidence_coverage double, signals map<string,double>, contradictions array<string>, has_confirmed_document boolean, has_date boolean, review_reason string")


def test_explanations_on_demand(spark, tmp_path):
    calls, cache = str(tmp_path / "calls"), str(tmp_path / "cache")
    os.makedirs(calls)

    def generator(text):
        """By score: a good text in quotes, a failure and then a good text, a failure always, a text too short, no end."""
        score = json.loads(text)["confidence"]
        before = sum(name.startswith(f"{score}-") for name in os.listdir(calls))
        open(f"{calls}/{score}-{uuid.uuid4().hex}", "w").close()
        if score == 0.63 or score == 0.72 and not before:
            raise ValueError("unavailable")
        if score == 0.58:
            time.sleep(60)
        return "too short" if score == 0.59 else f'"The amounts\n agree and the dates differ,  at {score}."'

    explain = lambda frame, g=generator: {r.match_id: r for r in generate.explain_on_demand(frame, cache, g, "remote", "m1", seconds=8, at_once=5).collect()}
    got = explain(candidates(spark))
    assert got[1].explanation == "The amounts agree and the dates differ, at 0.81." and got[2].explanation.endswith("at 0.72.")
    assert {m: r.provider for m, r in got.items()} == {1: "remote", 2: "remote", 3: "local", 4: "local", 5: "local"}
    assert not any(r.cached for r in got.values()) and all(20 <= len(r.explanation) for r in got.values())
    made = len(os.listdir(calls))
    assert made == 1 + 2 + 2 + 1 + 1

    again = explain(candidates(spark))  # all kept: nothing is called
    assert len(os.listdir(calls)) == made and all(r.cached for r in again.values())
    assert {m: (r.explanation, r.provider, r.model) for m, r in again.items()} == {m: (r.explanation, r.provider, r.model) for m, r in got.items()}

    other = explain(candidates(spark, changed=4))  # only match 4 has another input: the gap of the best stays
    assert {m for m, r in other.items() if not r.cached} == {4} and len(os.listdir(calls)) == made + 1
    local = {r.match_id: r for r in generate.explain_on_demand(candidates(spark), str(tmp_path / "none")).collect()}
    assert {r.provider for r in local.values()} == {"local"} and local[3].explanation == got[3].explanation
    assert generate.explain_on_demand(candidates(spark).limit(0), str(tmp_path / "empty")).count() == 0
