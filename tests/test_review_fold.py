"""The fold of decisions against one that takes them one after the other."""

from __future__ import annotations

import datetime as dt
import random

from ledgerloom.operators import review


def one_by_one(matches, acts):
    row = {m[0]: m for m in matches}
    status, error = {m[0]: m[3] for m in matches}, {}
    held = lambda tx: [row[i][1] for i, s in status.items() if row[i][2] == tx and s in ("CONFIRMED", "AUTO_CONFIRMED")]
    for i, action, _, _ in sorted(acts, key=lambda a: (a[2], a[3])):
        now, want = status[i], "CONFIRMED" if action == "CONFIRM" else "REJECTED"
        if now == want or (now, want) == ("AUTO_CONFIRMED", "CONFIRMED"):
            continue
        if now != "CANDIDATE":
            error[i] = "NOT_OPEN"
        elif want == "CONFIRMED" and any(d != row[i][1] for d in held(row[i][2])):
            error[i] = "TRANSACTION_TAKEN"
        else:
            status[i] = want
            if want == "CONFIRMED":
                status |= {o: "REJECTED" for o, m in row.items() if m[1] == row[i][1] and status[o] == "CANDIDATE"}
    return {i: (s, error.get(i)) for i, s in status.items()}


def test_fold_like_one_by_one(spark):
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(12), rng.randrange(9)) for _ in range(40)})
    matches = [(i, d, 100 + t, "CANDIDATE") for i, (d, t) in enumerate(pairs)]
    matches[3] = (*matches[3][:3], "AUTO_CONFIRMED")
    acts = [(rng.randrange(len(matches)), rng.choice(["CONFIRM", "REJECT"]), dt.datetime(2025, 1, 1, 0, rng.randrange(9)), n) for n in range(30)]
    found = review.fold_decisions(
        spark.createDataFrame(matches, "id long, document_id long, transaction_id long, status string"),
        spark.createDataFrame(acts, "match_id long, action string, decided_at timestamp, seq long"))
    assert {r.id: (r.status, r.error) for r in found.collect()} == one_by_one(matches, acts)
