"""Boundary tables of the scoring rules, and the ten fixture documents."""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF
from ledgerloom import catalog
from ledgerloom.functions import scoring, text
from ledgerloom.operators import assignment, dedup, evaluation, review
from ledgerloom.operators.components import connected_components
from ledgerloom.plans import ingestion, matching, views
from ledgerloom.sources import webhooks

AMOUNTS = [  # document, transaction, tip allowed, score
    (10000, 10000, True, 1.0), (9900, 10000, True, 1.0), (9899, 10000, True, 1 - (0.0101 / 0.3) * 0.5), (7000, 10000, True, 0.5), (6999, 10000, True, 0.0), (9000, 10000, False, 0.0),
    (10150, 10000, True, 0.9), (10200, 10000, True, 0.9), (10201, 10000, True, 0.0), (0, 10000, True, 0.0), (10000, 0, True, 0.0), (100000, 100200, False, 1.0)]


def test_score_amount(spark):
    rows = spark.createDataFrame(AMOUNTS, "d long, t long, tip boolean, want double")
    for row in rows.withColumn("got", scoring.score_amount(F.col("d"), F.col("t"), F.col("tip"))).collect():
        assert row.got == pytest.approx(row.want, abs=1e-9), row


def test_score_date(spark):
    base = dt.datetime(2025, 6, 14, 8)
    cases = [(0, 1.0), (10, 1.0), (16, 0.98), (24, 0.98), (72, 0.7), (48, 0.84), (14 * 24, 0.2), (14 * 24 + 1, 0.0), (-24, 0.98), (30 * 24, 0.0)]
    rows = spark.createDataFrame([(base, base + dt.timedelta(hours=h), w) for h, w in cases], "a timestamp, b timestamp, want double")
    for row in rows.withColumn("got", scoring.score_date(F.col("a"), F.col("b"))).collect():
        assert row.got == pytest.approx(row.want, abs=1e-9), row


def test_normalize_merchant(spark):
    cases = [("Alrajhi Auto Service", "ALRAJHI AUTO SERVICE"), ("ALFANAR FUEL ST 04 RUH", "ALFANAR FUEL"), ("The Panda Supermarket Co.", "PANDA SUPERMARKET"), ("محطة الفنار 12", "الفنار"), ("إكسترا", "اكسترا"), ("", ""), ("12 34", ""), ("مؤسسة نور", "موسسة نور"), ("Café Ñandú", "CAFE NANDU")]
    got = {r.name: r.normalized for r in text.merchant_dictionary(spark.createDataFrame([(a,) for a, _ in cases], "n string"), "n").collect()}
    assert got == dict(cases)


def test_phone_card_identifier(spark):
    row = spark.sql("SELECT '966 55-123' AS p, 'none' AS q, '٤٤١١' AS c, ' inv-٠١/a ' AS i").select(
        text.normalize_phone("p").alias("p"), text.normalize_phone("q").alias("q"), text.normalize_card("c").alias("c"), text.normalize_identifier("i").alias("i")).first()
    assert tuple(row) == ("+96655123", "none", "4411", "INV01A")


def test_merchant_symmetry_and_bounds(spark):
    names = ["ALFANAR FUEL", "PETROMIN EXPRESS", "PETROMIN", "NOUR CAFE", "الفنار", "", "A", "AL BAIK REST", "ALBAIK"]
    pairs = spark.createDataFrame(list(itertools.product(names, names)), "a string, b string")
    for r in pairs.select("*", scoring.score_merchant(F.col("a"), F.col("b")).alias("x"), scoring.score_merchant(F.col("b"), F.col("a")).alias("y")).collect():
        assert r.x == r.y and 0 <= r.x <= 1
        assert (r.x == 1) == (r.a == r.b != "")


def ledger(spark):
    at = lambda s: dt.datetime.strptime(s, "%Y-%m-%dT%H:%M")
    rows = [
        (1, 1, "ALFANAR FUEL ST 04 RUH", 25000, "2025-06-14T08:15"), (2, 1, "ALFANAR FUEL ST 04 RUH", 25000, "2025-06-14T09:32"), (3, 1, "MARHABA REST AL MALAZ RUH", 6325, "2025-06-17T12:33"),
        (4, 1, "ALRAJHI AUTO SVC RUH", 120000, "2025-06-20T10:05"), (5, 1, "PANDA SUPERMARKET", 42000, "2025-06-18T18:14"), (6, 1, "STC PAYMENT", 50000, "2025-06-16T15:00"),
        (7, 1, "ALFANAR FUEL ST 12 JED", 18000, "2025-06-15T09:00"), (8, 2, "PETROMIN EXPRESS JED HAMRA", 30000, "2025-06-14T08:03"), (9, 2, "AL BAIK REST JED", 8500, "2025-06-15T13:00"),
        (10, 2, "EXTRA ELECTRONICS", 250000, "2025-06-17T14:00"), (11, 2, "CAREEM RIDE", 4200, "2025-06-19T22:00"), (12, 2, "NESMA TOLL", 2500, "2025-06-18T09:00"), (13, 2, "AL BAIK REST JED", 4500, "2025-06-20T13:00"),
        (14, 2, "PETROMIN EXPRESS JED", 14550, "2025-06-16T11:00"), (15, 2, "ALFANAR FUEL ST 22 JED", 20000, "2025-06-19T07:00"), (16, 1, "NOUR CAFE BR 04 RUH", 8750, "2025-06-22T08:15"), (17, 1, "NOUR CAFE BR 12 JED", 8750, "2025-06-22T08:45")]
    city = {16: "RIYADH", 17: "JEDDAH"}
    data = [
        (i, c, "4411" if c == 1 else "8823", "+966501111111" if c == 1 else "+966502222222", m, "300123456700003" if i == 4 else None, None, None, "CAFE" if i > 15 else None, city.get(i), a, "SAR", at(t))
        for i, c, m, a, t in rows]
    return spark.createDataFrame(data, "tx_id long, client_id long, tx_card string, driver_phone string, tx_merchant string, tx_vat string, tx_invoice string, tx_auth string, tx_category string, tx_city_name string, tx_amount long, tx_currency string, tx_at timestamp")


FIELDS = "doc_id long, source string, sender_identifier string, doc_type string, doc_merchant string, doc_amount long, doc_currency string, doc_date string, doc_card string, doc_vat string, doc_invoice string, conf string, received_at timestamp"


def documents(spark):
    received = dt.datetime(2025, 6, 17, 9)
    mail, one, two = ("EMAIL", "Fleet@alrashed.example"), ("WHATSAPP", "966501111111"), ("WHATSAPP", "966502222222")
    rows = [
        (1, *mail, "TAX_INVOICE", "Alrajhi Auto Service", 120000, "SAR", "2025-06-20 10:04:00", "4411", "300123456700003", "AR-INV-99812", ""),
        (2, *mail, "TAX_INVOICE", "Alrajhi Auto Service", 120000, "SAR", "2025-06-20 10:04:00", "4411", "300123456700003", "AR-COPY-99812", ""),
        (3, *one, "RECEIPT", "ALFANAR FUEL STATION", 25000, "SAR", "2025-06-14 08:22:00", None, None, "20250614-3", ""),
        (4, *one, "RECEIPT", "STC Payment", 50000, "SAR", None, None, None, None, "merchant=.96 amount=.98"),
        (5, *one, "RECEIPT", "NOUR CAFE BR 04 RUH", 8750, "SAR", "2025-06-22 08:20:00", "4411", None, None, ""),
        (6, *one, "RECEIPT", "Marhaba Restaurant", 5750, "SAR", "2025-06-17 12:31:00", "4411", None, "44-8817", ""),
        (7, *two, "RECEIPT", "Petromin Express", 30000, "SAR", "2025-06-14 08:03:00", "8823", None, "PX-20250614-118", ""),
        (8, *mail, "TAX_INVOICE", "Zamil Steel Industries", 100000, "SAR", "2025-06-14 00:00:00", None, "300777889900003", None, ""),
        (9, *one, "RECEIPT", "Panda Supermarket", 42000, "USD", "2025-06-18 18:14:00", "4411", None, None, "currency=.99 amount=.98")]
    frame = spark.createDataFrame([(*r, received) for r in rows], FIELDS)
    conf = lambda f: F.regexp_extract("conf", rf"{f}=([0-9.]+)", 1)
    return frame.select(
        "*", F.lit(None).cast("string").alias("doc_auth"), F.when(F.col("doc_date").isNull(), "RECEIVED_AT").otherwise("PRINTED").alias("doc_date_source"),
        *[F.nullif(conf(f), F.lit("")).cast("double").alias(f"conf_{f}") for f in ("amount", "date", "merchant", "card", "currency", "vat", "invoice", "auth")],
    ).withColumn("doc_date", F.coalesce(F.to_timestamp("doc_date"), "received_at")).drop("conf")


def emails(spark):
    return spark.createDataFrame([(1, 1, "fleet@alrashed.example"), (2, 2, "ops@najm.example")], "id long, client_id long, email string")


def test_fixture_outcomes(spark):
    final = {r.doc_id: r for r in matching.match(documents(spark), ledger(spark), emails(spark), audit_rate=0).collect()}
    status = {i: (r.status, r.tx_id) for i, r in final.items()}
    assert status[1] == ("MATCHED", 4) and status[2] == ("NEEDS_REVIEW", 4)
    assert final[3].status == "NEEDS_REVIEW" and [c.tx_id for c in final[3].candidates][:2] == [1, 2]
    assert final[3].candidates[0].decision_confidence == final[3].candidates[1].decision_confidence == pytest.approx(0.882, abs=0.002)
    assert final[4].status == "NEEDS_REVIEW" and final[4].top_score == pytest.approx(0.787, abs=0.002)
    assert final[5].status == "NEEDS_REVIEW" and [c.tx_id for c in final[5].candidates][:2] == [16, 17]
    assert status[6] == ("MATCHED", 3) and final[6].top_score == pytest.approx(0.823, abs=0.002)
    assert status[7] == ("MATCHED", 8) and final[7].top_score >= 0.95
    assert final[8].status == "UNMATCHED" and final[9].status == "UNMATCHED"
    assert final[9].status_reason == "NO_CANDIDATE_ABOVE_DISPLAY_THRESHOLD" and final[9].top_score == pytest.approx(0.253, abs=0.005)


def test_unknown_sender_and_empty_tables(spark):
    docs = documents(spark).withColumn("sender_identifier", F.lit("who@else.example")).withColumn("source", F.lit("EMAIL"))
    assert {r.status_reason for r in matching.match(docs, ledger(spark), emails(spark)).collect()} == {"NO_SCOPED_TRANSACTIONS"}
    assert matching.match(documents(spark).limit(0), ledger(spark), emails(spark)).count() == 0


def test_rematch_assigns_one_to_one(spark):
    matches = spark.createDataFrame([], "id long, document_id long, transaction_id long, status string")
    rows = matching.rematch(documents(spark).where("doc_id in (1, 2)"), ledger(spark), emails(spark), matches).collect()
    assert sorted(r.status for r in rows) == ["MATCHED", "NEEDS_REVIEW"]


def test_rematch_and_fold_take_all_receipts(spark):
    docs, rows = views.receipts(spark, SF).where("extraction_confidence >= 0.3"), views.ledger(spark, SF)
    own = {r.doc_id for r in docs.select("doc_id").collect()}
    before = rows.where(~F.col("tx_id").isin(*own))
    want = {r.doc_id for r in matching.match(docs, before, views.client_email(spark, SF)).where("status = 'UNMATCHED'").collect()}
    got = [r.doc_id for r in catalog.QUERIES["q_rematch"](spark, SF).collect()]
    assert len(want) > len(own) / 9 and sorted(got) == sorted(want)
    folded = {r.document_id for r in catalog.QUERIES["q_decision_fold"](spark, SF).collect()}
    assert folded == {r.doc_id for r in views.receipts(spark, SF).collect()}


def best_total(scores):
    """The largest sum of scores, by trying every assignment of a few documents."""
    documents, best = sorted({d for d, _ in scores}), 0.0
    for chosen in itertools.product(*[[None, *(t for e, t in scores if e == d)] for d in documents]):
        taken = [t for t in chosen if t is not None]
        if len(set(taken)) == len(taken):
            best = max(best, sum(scores[d, t] for d, t in zip(documents, chosen, strict=True) if t is not None))
    return best


def test_assignment_is_best(spark):
    """Many small groups of competitors, with ties, in one auction, against every assignment of each."""
    rng, rows = random.Random(4), []
    for group in range(80):
        few = [round(rng.random(), 3) for _ in range(rng.choice([1, 2, 5]))] + [0.0, 1.0, 0.001]
        rows += [(group * 10 + d, group * 10 + t, rng.choice(few) if rng.random() < 0.7 else round(rng.random(), 3))
                 for d in range(rng.randint(1, 4)) for t in range(rng.randint(1, 4)) if rng.random() < 0.8]
    groups = {}
    for d, t, s in rows:
        own = groups.setdefault(d // 10, {})
        own[d, t] = max(s, own.get((d, t), 0.0))
    odd = [(None, 1, 0.9), (1, None, 0.9), (5000, 5001, None), (6000, 6001, 7.5), (6000, 6001, 0.2), (6002, 6003, -1.0)]
    edges = spark.createDataFrame(rows + rows[::3] + odd, "document_id long, transaction_id long, score double")
    got = assignment.assign(edges, minimum=0.0).collect()
    assert len({r.document_id for r in got}) == len({r.transaction_id for r in got}) == len(got)
    for group, scores in groups.items():
        own = [r for r in got if r.document_id < 5000 and r.document_id // 10 == group]
        assert all(scores[r.document_id, r.transaction_id] == r.score for r in own)
        assert sum(r.score for r in own) == pytest.approx(best_total(scores)), group
    assert [(r.document_id, r.score) for r in got if r.document_id >= 5000] == [(6000, 1.0)]
    assert assignment.assign(edges.limit(0)).count() == 0


def test_assignment_of_a_ring(spark):
    """One group as long as all documents: everyone's second choice is the next one's first; within a part for each."""
    n = 12
    rows = [(i, i, 0.9) for i in range(n)] + [(i, (i + 1) % n, 0.9 if i % 2 else 0.8) for i in range(n)] + [(n + i, i, 0.85) for i in range(0, n, 6)]
    got = assignment.assign(spark.createDataFrame(rows, "document_id long, transaction_id long, score double"), minimum=0.0).collect()
    assert len({r.transaction_id for r in got}) == len(got) == n
    assert sum(r.score for r in got) >= 0.9 * n - n * 2 / 1000 / 16


def rival_groups(groups, size):
    """Edges of contested groups, every document of one with three of its transactions, of few and so often equal scores."""
    rng = random.Random(5)
    return [(g * 1000 + d, g * 1000 + t, rng.choice([0.6, 0.7, 0.701, 0.9])) for g in range(groups) for d in range(size) for t in rng.sample(range(size - 1), 3)]


def test_groups_are_settled_without_rounds(spark, monkeypatch):
    """Groups of rivals are settled in tasks, also where they begin in one Arrow batch and end in another; only larger ones are auctioned."""
    edges = spark.createDataFrame(rival_groups(30, 40), "document_id long, transaction_id long, score double")
    auctioned = []
    monkeypatch.setattr(assignment, "auction", lambda graph, held=assignment.auction: auctioned.append(1) or held(graph))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    totals = []
    try:
        for batch in (7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = assignment.assign(edges, minimum=0.0).collect()
            assert len({r.document_id for r in got}) == len({r.transaction_id for r in got}) == len(got) > 30 * 30
            totals.append(sorted(map(tuple, got)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert totals[0] == totals[1] and not auctioned
    few = spark.createDataFrame(rival_groups(1, 6), edges.schema)
    exact, bid = (assignment.assign(few, minimum=0.0, most=most).agg(F.sum("score")).first()[0] for most in (1000, 0))
    assert auctioned and bid == pytest.approx(exact)


def test_components_by_the_least_loss():
    """Against every assignment, where some documents had better go without."""
    rng = random.Random(6)
    for _ in range(300):
        scores = {(d, t): rng.choice([1, 2, 5, 7, 8]) for d in range(rng.randint(1, 4)) for t in range(4) if rng.random() < 0.6}
        offers = [[(t, v) for (e, t), v in scores.items() if e == d] for d in range(4)]
        own = assignment.best_choice(offers, 4)
        taken = [t for t in own if t >= 0]
        assert len(set(taken)) == len(taken) and sum(scores[d, t] for d, t in enumerate(own) if t >= 0) == best_total(scores)


def test_assignment_example(spark):
    edges = spark.createDataFrame([(1, 10, 0.9), (1, 20, 0.89), (2, 10, 0.88), (3, 30, 0.4)], "document_id long, transaction_id long, score double")
    assert {(r.document_id, r.transaction_id) for r in assignment.assign(edges).collect()} == {(1, 20), (2, 10)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 200), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 90: 90, 95: 90, 100: 90, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_survivors_are_not_transitive(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, None, "y"), (5, None, None), (6, "b", None)], "id long, k string, l string")
    assert {r.id: r.survives for r in dedup.survivors(rows, [["k"], ["l"]]).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_metrics(spark):
    rows = spark.createDataFrame([(0.95, True, True, 1), (0.9, True, True, 1), (0.7, False, False, 2), (0.5, False, False, None)], "score double, correct boolean, auto_matched boolean, rank_of_correct int")
    m = evaluation.metrics(rows).first()
    assert (m.top1_accuracy, m.auto_precision, m.auto_coverage, m.review_rate) == (0.5, 1.0, 0.5, 0.5)
    assert [r.recall for r in evaluation.recall_at(rows).collect()] == [0.5, 0.75, 0.75]
    t = evaluation.threshold(rows, 1.0).first()
    assert (t.threshold, t.precision, t.coverage) == (0.9, 1.0, 0.5)
    empty = evaluation.metrics(rows.limit(0)).first()
    assert empty.examples == 0 and empty.auto_precision is None and empty.brier_score == 0


def test_isotonic(spark):
    rows = spark.createDataFrame([(0.1, False), (0.2, True), (0.3, False), (0.8, True)], "score double, correct boolean")
    points = evaluation.isotonic_points(rows)
    assert [(p.max_score, p.calibrated_probability) for p in points.orderBy("ord").collect()] == [(0.1, 0.0), (0.3, 0.5), (0.8, 1.0)]
    scores = spark.createDataFrame([(0.05,), (0.25,), (0.9,)], "score double")
    assert [r.calibrated for r in evaluation.calibrated(scores, points).orderBy("score").collect()] == [0.0, 0.5, 1.0]


def test_names_beyond_ascii(spark):
    docs = documents(spark).where("doc_id = 5").withColumn("doc_merchant", F.lit("Café Ñandú"))
    rows = ledger(spark).where("tx_id in (16, 17)").withColumn("tx_merchant", F.when(F.col("tx_id") == 16, "CAFE NANDU RUH").otherwise("CAF DU"))
    final = matching.match(docs, rows, emails(spark), audit_rate=0).first()
    assert final.candidates[0].tx_id == 16 and dict(final.candidates[0].signals)["merchant"] == 1
    one = spark.createDataFrame([(1, "Café Ñandú", "Çelik", dt.datetime(2025, 1, 1), 1)], "client_id long, document_merchant string, transaction_merchant string, decided_at timestamp, id long")
    learned = review.learned_aliases(one).first()
    assert (learned.normalized_alias, learned.canonical_normalized) == ("CAFE NANDU", "CELIK")
    scored = matching.match(docs, rows.withColumn("tx_merchant", F.lit("Çelik")), emails(spark), aliases=review.learned_aliases(one), audit_rate=0).first()
    assert dict(scored.candidates[0].signals)["merchant"] > 0.8


def test_ingestion_to_stored_match_and_late_transaction(spark):
    received = dt.datetime(2025, 6, 21, 9)
    rows = [("EMAIL", "m1", "fleet@alrashed.example", b"one"), ("EMAIL", "m1", "fleet@alrashed.example", b"one"), ("EMAIL", "m2", "Fleet@alrashed.example", b"one"),
            ("EMAIL", "m3", "fleet@alrashed.example", b"two"), ("EMAIL", "m4", "fleet@alrashed.example", b"unreadable"), ("EMAIL", "m5", "fleet@alrashed.example", b"same invoice")]
    docs = spark.createDataFrame([(*r, received, "image/png") for r in rows], "source string, external_id string, sender_identifier string, content binary, received_at timestamp, mime_type string")
    fields = {b"one": ("TAX_INVOICE", "Alrajhi Auto Service", 120000, "2025-06-20 10:04:00", "AR-1"), b"two": ("RECEIPT", "Late Garage", 7700, "2025-05-01 12:00:00", None), b"unreadable": ("UNKNOWN", None, None, None, None), b"same invoice": ("TAX_INVOICE", "Alrajhi Auto Service", 120000, "2025-06-20 10:04:00", "AR-1")}
    known = spark.createDataFrame([(hashlib.sha256(c).hexdigest(), kind, name, amount, date, invoice, "SAR", "4411", 0.9) for c, (kind, name, amount, date, invoice) in fields.items()],
        "content_hash string, document_type string, merchant_name string, total_amount long, document_date string, invoice_number string, currency string, card_last4 string, extraction_confidence double")
    for field in webhooks.EXTRACTED.fields:
        if field.name not in known.columns:
            known = known.withColumn(field.name, F.lit(None).cast(field.dataType))
    final, stored = ingestion.ingested(docs, lambda d: webhooks.extracted_by_hash(d.drop("content_hash"), known), emails(spark), ledger(spark), audit_rate=0)
    status = {r.external_id: (r.status, r.status_reason) for r in final.collect()}
    assert status == {"m1": ("MATCHED", "AUTO_MATCHED"), "m2": ("DUPLICATE", None), "m3": ("UNMATCHED", status["m3"][1]), "m4": ("FAILED", "LOW_QUALITY_EXTRACTION"), "m5": ("DUPLICATE", None)}
    assert [(r.transaction_id, r.match_status) for r in stored.collect()] == [(4, "AUTO_CONFIRMED")]
    again, none = ingestion.ingested(docs, lambda d: webhooks.extracted_by_hash(d.drop("content_hash"), known), emails(spark), ledger(spark), stored=final, audit_rate=0)
    assert again.count() == 0 and none.count() == 0
    late = ledger(spark).where("tx_id = 4").withColumn("tx_id", F.lit(99).cast("long")).withColumn("tx_merchant", F.lit("LATE GARAGE RUH")).withColumn("tx_amount", F.lit(7700).cast("long")).withColumn(
        "tx_at", F.to_timestamp(F.lit("2025-05-01 12:05:00"))).withColumn("tx_vat", F.lit(None).cast("string"))
    waiting = matching.rematch_scope(final, emails(spark), late)
    assert [r.external_id for r in waiting.collect()] == ["m3"]
    assert matching.rematch_scope(final, emails(spark), late.limit(0)).count() == 0
    held = stored.select(F.lit(1).cast("long").alias("id"), F.col("document_id"), F.col("transaction_id"), F.col("match_status").alias("status"))
    met = matching.rematch(ingestion.matchable(waiting), ledger(spark).unionByName(late), emails(spark), held).first()
    assert (met.status, met.tx_id, met.status_reason) == ("MATCHED", 99, "AUTO_MATCHED_AFTER_REMATCH")


def test_queue_with_matches(spark):
    documents_ = spark.createDataFrame([(1, "NEEDS_REVIEW", dt.datetime(2025, 1, 1)), (2, "MATCHED", dt.datetime(2025, 1, 1))], "id long, status string, received_at timestamp")
    rows = [(10, 1, 5, 1, 0.8), (11, 1, 6, 2, 0.8), (12, 1, 7, 3, 0.6), (13, 2, 5, 1, 0.9)]
    matches = spark.createDataFrame(rows, "id long, document_id long, transaction_id long, rank int, decision_confidence double").select(
        "*", F.lit(0.7).alias("confidence"), F.lit(0.7).alias("evidence_coverage"), F.array().cast("array<string>").alias("contradictions"), F.lit("CANDIDATE").alias("status"))
    (row,) = review.queue_with_matches(documents_, matches).collect()
    assert row.doc_id == 1 and [(c.id, c.tied_for_best, c.recommended) for c in row.candidates] == [(10, True, False), (11, True, False), (12, False, False)]
    assert review.candidate_counts(matches).where("document_id = 1").first().remaining == 3
