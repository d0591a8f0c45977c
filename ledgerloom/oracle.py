"""SQL that says the same as the queries of the catalog, for another engine over the same tables."""

from __future__ import annotations

from ledgerloom.constants import NOISE_TOKENS

LEDGER = """
ledger AS (
    SELECT o_orderkey AS tx_id, c_nationkey::BIGINT AS client_id, '+' || (966500000000 + o_custkey)::VARCHAR AS driver_phone,
        lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS tx_card,
        upper(p_name) || ' ST 0' || (o_orderkey % 9 + 1)::VARCHAR || ' ' || (['RUH', 'JED', 'DMM', 'MED'])[o_custkey % 4 + 1] AS tx_merchant,
        CASE WHEN o_orderkey % 7 = 0 THEN '3000000' || lpad(c_nationkey::VARCHAR, 4, '0') END AS tx_vat,
        CASE WHEN o_orderkey % 6 = 0 THEN 'INV-' || o_orderkey::VARCHAR END AS tx_invoice,
        CASE WHEN o_orderkey % 11 = 0 THEN 'A' || o_orderkey::VARCHAR END AS tx_auth,
        CASE WHEN o_orderkey % 5 = 0 THEN 'CAFE' END AS tx_category,
        floor(o_totalprice * 100 + 0.5e0)::BIGINT AS tx_amount, 'SAR' AS tx_currency, o_orderdate AS tx_at, p_name AS part_name, o_custkey AS cust
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
)"""
RECEIPTS = """
base AS (SELECT *, (tx_id // 3) % 10 AS kind, CASE WHEN tx_id % 13 <> 0 THEN tx_at + to_days((tx_id % 6)::INTEGER) END AS printed, tx_at + INTERVAL 7 DAY AS received FROM ledger WHERE tx_id % 3 = 0),
receipts AS (
    SELECT tx_id AS doc_id, 'OPS@nation' || client_id::VARCHAR || '.example' AS sender_identifier, client_id AS doc_client,
        CASE WHEN tx_id % 2 = 0 THEN 'RECEIPT' ELSE 'TAX_INVOICE' END AS doc_type,
        floor(tx_amount::DOUBLE * CASE kind WHEN 5 THEN 1.001e0 WHEN 6 THEN 0.91e0 WHEN 7 THEN 1.015e0 WHEN 8 THEN 0.6e0 ELSE 1e0 END + 0.5e0)::BIGINT AS doc_amount,
        CASE WHEN kind = 9 THEN 'USD' ELSE 'sar ' END AS doc_currency, coalesce(printed, received) AS doc_date,
        CASE WHEN printed IS NULL THEN 'RECEIVED_AT' ELSE 'PRINTED' END AS doc_date_source, CASE WHEN tx_id % 4 <> 0 THEN tx_card END AS doc_card,
        part_name || ' Station' AS doc_merchant, tx_vat AS doc_vat, CASE WHEN tx_id % 12 = 0 THEN tx_invoice END AS doc_invoice, tx_auth AS doc_auth, received AS received_at,
        CASE WHEN tx_id % 7 < 3 THEN 0.9e0 END AS conf_amount, CASE WHEN tx_id % 7 = 3 THEN 0.5e0 END AS conf_date, CASE WHEN tx_id % 7 = 4 THEN 0.75e0 END AS conf_merchant,
        CASE WHEN tx_id % 7 = 5 THEN 0.6e0 END AS conf_card, CASE WHEN tx_id % 2 = 0 THEN 0.95e0 END AS conf_currency,
        CASE WHEN tx_id % 50 = 0 THEN 0.2e0 ELSE 0.9e0 END AS extraction_confidence
    FROM base
),
docs AS (SELECT * FROM receipts WHERE extraction_confidence >= 0.3e0)"""

NOISE = "[" + ", ".join(f"'{t}'" for t in NOISE_TOKENS if t.isascii()) + "]"


def normalized(name: str) -> str:
    """ASCII names only."""
    return f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(upper({name}), '[^A-Z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+') AND NOT list_contains({NOISE}, t)), ' ')"


def city(name: str) -> str:
    upper = f"regexp_replace(upper({name}), '[^A-Z0-9\\s]', ' ', 'g')"
    whens = " ".join(f"WHEN regexp_matches({upper}, '\\b({p})\\b') THEN '{c}'" for c, p in (("RIYADH", "RUH|RIYADH"), ("JEDDAH", "JED|JEDDAH"), ("DAMMAM", "DMM|DAMMAM"), ("MADINAH", "MED|MADINAH")))
    return f"CASE {whens} END"


def branch(name: str) -> str:
    upper = f"regexp_replace(upper({name}), '[^A-Z0-9\\s]', ' ', 'g')"
    return f"coalesce(nullif(regexp_extract({upper}, '\\bBR(ANCH)?\\b\\s*([0-9]+)', 2), ''), nullif(regexp_extract({upper}, '\\b(ST|STORE|BR)\\s+([0-9]+)\\b', 2), ''))"


def grams(name: str) -> str:
    compact = f"replace({name}, ' ', '')"
    return f"list_transform(range(1, greatest(length({compact}), 1)), lambda i: substring({compact}, i, 2))"


def round3(x: str) -> str:
    return f"(floor(({x}) * 1000 + 0.5e0) / 1000)"


NAMES = f"""
doc_names AS (SELECT doc_merchant, {normalized('doc_merchant')} AS doc_core, {city('doc_merchant')} AS doc_city, {branch('doc_merchant')} AS doc_branch FROM (SELECT DISTINCT doc_merchant FROM docs)),
tx_names AS (SELECT tx_merchant, {normalized('tx_merchant')} AS tx_core, {city('tx_merchant')} AS tx_city, {branch('tx_merchant')} AS tx_branch FROM (SELECT DISTINCT tx_merchant FROM ledger)),
core_pairs AS (SELECT doc_core, tx_core, string_split(doc_core, ' ') AS a, string_split(tx_core, ' ') AS b, {grams('doc_core')} AS x, {grams('tx_core')} AS y FROM (SELECT DISTINCT doc_core FROM doc_names), (SELECT DISTINCT tx_core FROM tx_names)),
core_parts AS (
    SELECT *, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS jaccard,
        CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0e0 ELSE 2e0 * coalesce(list_sum(list_transform(list_distinct(x), lambda g: least(len(list_filter(x, lambda h: h = g)), len(list_filter(y, lambda h: h = g))))), 0)::DOUBLE / (len(x) + len(y)) END AS dice
    FROM core_pairs),
core_scores AS (SELECT *, {round3("CASE WHEN doc_core = '' OR tx_core = '' THEN 0e0 WHEN doc_core = tx_core THEN 1e0 ELSE 0.5e0 * jaccard + 0.5e0 * dice END")} AS merchant_score FROM core_parts)"""

NEAR = "abs(epoch_us(doc_date) - epoch_us(tx_at)) <= {days} * 86400000000"
BAND = "tx_amount BETWEEN greatest(1, doc_amount - greatest(100, floor(doc_amount * 0.3e0 + 0.5e0))) AND doc_amount + greatest(100, floor(doc_amount * 0.3e0 + 0.5e0))"
SCOPED = "docs JOIN ledger ON client_id = doc_client"
IDENTIFIED = "(doc_auth = tx_auth OR doc_invoice = tx_invoice OR doc_vat = tx_vat)"
# Of each block the newest 200 transactions of a document.
CAPPED = f"""
blocks AS (
    SELECT doc_id, tx_id, tx_at, 0 AS block FROM {SCOPED} WHERE {IDENTIFIED}
    UNION ALL SELECT doc_id, tx_id, tx_at, 1 FROM {SCOPED} WHERE {NEAR.format(days=14)} AND doc_card = tx_card
    UNION ALL SELECT doc_id, tx_id, tx_at, 2 FROM {SCOPED} WHERE {NEAR.format(days=14)} AND {BAND}
    UNION ALL SELECT doc_id, tx_id, tx_at, 3 FROM {SCOPED} WHERE {NEAR.format(days=30)}),
chosen AS (
    SELECT DISTINCT doc_id, tx_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY tx_at DESC, tx_id) AS place FROM blocks) WHERE place <= 200)"""
PAIRS = CAPPED + """,
pairs AS (
    SELECT docs.*, ledger.* EXCLUDE (part_name, cust, driver_phone) FROM chosen JOIN docs ON docs.doc_id = chosen.doc_id JOIN ledger ON ledger.tx_id = chosen.tx_id)"""
FREQUENT = """
frequent AS (
    SELECT p.*, doc_core, doc_city, doc_branch, tx_core, tx_city, tx_branch, merchant_score,
        count(*) OVER (PARTITION BY doc_id, tx_core) AS merchant_frequency, count(*) OVER (PARTITION BY doc_id, tx_amount) AS amount_frequency
    FROM pairs p JOIN doc_names USING (doc_merchant) JOIN tx_names USING (tx_merchant) JOIN core_scores USING (doc_core, tx_core))"""
AMOUNT = """CASE WHEN doc_amount <= 0 OR tx_amount <= 0 THEN 0e0
    WHEN abs(doc_amount::DOUBLE - tx_amount) <= greatest(100, floor(tx_amount * 0.002e0 + 0.5e0)) THEN 1e0
    WHEN doc_amount < tx_amount THEN CASE WHEN {tip} AND (tx_amount::DOUBLE - doc_amount) / tx_amount <= 0.3e0 THEN 1e0 - (((tx_amount::DOUBLE - doc_amount) / tx_amount) / 0.3e0) * 0.5e0 ELSE 0e0 END
    WHEN (doc_amount::DOUBLE - tx_amount) / tx_amount <= 0.02e0 THEN 0.9e0 ELSE 0e0 END"""
TIP = "(doc_type = 'RECEIPT' AND regexp_matches(upper(coalesce(tx_category, '') || ' ' || tx_merchant), 'RESTAURANT|\\bREST\\b|CAFE|COFFEE|HOTEL|HOSPITALITY'))"
DAYS = "(abs(epoch_ms(doc_date) - epoch_ms(tx_at))::DOUBLE / 86400000e0)"
# Riyadh keeps three hours before UTC all year.
DATE = f"""CASE WHEN (doc_date + INTERVAL 3 HOUR)::DATE = (tx_at + INTERVAL 3 HOUR)::DATE THEN 1e0 WHEN {DAYS} <= 1 THEN 0.98e0
    WHEN {DAYS} <= 3 THEN 0.98e0 - (({DAYS} - 1) / 2) * 0.28e0 WHEN {DAYS} <= 14 THEN 0.7e0 - (({DAYS} - 3) / 11) * 0.5e0 ELSE 0e0 END"""
clamp = lambda x: f"greatest(0e0, least(1e0, {x}))"
IDENTIFIER = "regexp_replace(upper(trim({c})), '[^A-Z0-9]', '', 'g')"
same = lambda f: f"CASE WHEN coalesce(doc_{f}, '') <> '' AND coalesce(tx_{f}, '') <> '' THEN ({IDENTIFIER.format(c=f'doc_{f}')} = {IDENTIFIER.format(c=f'tx_{f}')})::INTEGER::DOUBLE END"
SCORED = f"""
signal AS (
    SELECT *, upper(trim(doc_currency)) <> upper(trim(tx_currency)) AS other_currency,
        CASE WHEN upper(trim(doc_currency)) <> upper(trim(tx_currency)) THEN 0e0 ELSE {clamp(AMOUNT.format(tip=TIP))} END AS s_amount, {clamp(DATE)} AS s_date,
        CASE WHEN doc_card IS NOT NULL THEN (doc_card = tx_card)::INTEGER::DOUBLE END AS s_card,
        CASE WHEN doc_city IS NOT NULL AND tx_city IS NOT NULL THEN (doc_city = tx_city)::INTEGER::DOUBLE END AS s_city,
        CASE WHEN doc_branch IS NOT NULL AND tx_branch IS NOT NULL THEN (doc_branch = tx_branch)::INTEGER::DOUBLE END AS s_branch,
        {same('vat')} AS s_vat, {same('invoice')} AS s_invoice, {same('auth')} AS s_auth
    FROM frequent),
blended AS (SELECT *, CASE WHEN s_city IS NULL THEN merchant_score ELSE 0.85e0 * merchant_score + 0.15e0 * s_city END AS with_city FROM signal),
named AS (SELECT *, {clamp("CASE WHEN s_branch IS NULL THEN with_city ELSE 0.9e0 * with_city + 0.1e0 * s_branch END")} AS s_merchant FROM blended),
weighted AS (
    SELECT *, 0.3e0 * {clamp("coalesce(conf_amount, 1e0)")} AS w_amount,
        0.2e0 * CASE WHEN doc_date_source = 'RECEIVED_AT' THEN least({clamp("coalesce(conf_date, 0.25e0)")}, 0.25e0) ELSE {clamp("coalesce(conf_date, 1e0)")} END AS w_date,
        0.25e0 * {clamp("coalesce(conf_merchant, 1e0)")} AS w_merchant, CASE WHEN s_card IS NULL THEN 0e0 ELSE 0.25e0 * {clamp("coalesce(conf_card, 1e0)")} END AS w_card,
        list_filter([CASE WHEN other_currency AND coalesce(conf_currency, 1e0) >= 0.8e0 THEN 'currency_mismatch' END, CASE WHEN s_card = 0 AND coalesce(conf_card, 1e0) >= 0.8e0 THEN 'card_last4_mismatch' END,
            CASE WHEN s_vat = 0 THEN 'vatNumber_mismatch' END, CASE WHEN s_invoice = 0 THEN 'invoiceNumber_mismatch' END, CASE WHEN s_auth = 0 THEN 'authorizationCode_mismatch' END], lambda x: x IS NOT NULL) AS contradictions
    FROM named),
summed AS (
    SELECT *, w_amount + w_date + w_merchant + w_card AS w_total, 0e0 + s_amount * w_amount + s_date * w_date + s_merchant * w_merchant + coalesce(s_card, 0e0) * w_card AS w_earned,
        3 + (s_card IS NOT NULL)::INTEGER AS n_signals FROM weighted),
first_base AS (SELECT *, CASE WHEN w_total > 0 THEN w_earned / w_total ELSE 0e0 END AS b0 FROM summed),
second_base AS (SELECT *, CASE WHEN coalesce(greatest(s_vat, s_invoice, s_auth), 0) = 1 AND b0 >= 0.7e0 THEN greatest(b0, 0.97e0) ELSE b0 END AS b1 FROM first_base),
third_base AS (SELECT *, b1 + CASE WHEN s_merchant >= 0.6e0 THEN 0.02e0 * {round3("1e0 / sqrt(merchant_frequency::DOUBLE)")} ELSE 0e0 END + CASE WHEN s_amount >= 0.8e0 THEN 0.01e0 * {round3("1e0 / sqrt(amount_frequency::DOUBLE)")} ELSE 0e0 END AS b2 FROM second_base),
fourth_base AS (SELECT *, CASE WHEN len(contradictions) > 0 THEN b2 * pow(0.35e0, len(contradictions)) ELSE b2 END AS raw_confidence, {round3(clamp("w_total"))} AS evidence_coverage FROM third_base),
scored AS (SELECT *, {round3(clamp("raw_confidence"))} AS confidence, {round3(clamp("raw_confidence * sqrt(evidence_coverage)"))} AS decision_confidence FROM fourth_base)"""
RANKED = """
shown AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY decision_confidence DESC, confidence DESC, tx_id) AS rank FROM scored WHERE decision_confidence >= 0.35e0),
ranked AS (SELECT *, decision_confidence - coalesce(lead(decision_confidence) OVER (PARTITION BY doc_id ORDER BY rank), 0e0) AS gap FROM shown WHERE rank <= 5)"""
OUTCOMES = """
counts AS (SELECT doc_id, count(*) AS scoped, max(decision_confidence) AS best FROM scored GROUP BY doc_id),
tops AS (SELECT *, decision_confidence >= 0.82e0 AND gap >= 0.12e0 AND evidence_coverage >= 0.7e0 AND n_signals >= 3 AND doc_date_source <> 'RECEIVED_AT' AND len(contradictions) = 0 AS auto,
    (SELECT count(*) FROM ranked r WHERE r.doc_id = ranked.doc_id) AS displayed FROM ranked WHERE rank = 1),
decided AS (
    SELECT d.doc_id, d.received_at, scoped, best, t.displayed, t.decision_confidence AS top, t.tx_id, t.gap, t.auto,
        CASE WHEN scoped IS NULL THEN 'NO_SCOPED_TRANSACTIONS' WHEN t.doc_id IS NULL THEN 'NO_CANDIDATE_ABOVE_DISPLAY_THRESHOLD' WHEN t.decision_confidence < 0.55e0 THEN 'TOP_SCORE_BELOW_REVIEW_THRESHOLD' END AS reason
    FROM docs d LEFT JOIN counts USING (doc_id) LEFT JOIN tops t ON t.doc_id = d.doc_id),
outcomes AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'UNMATCHED' WHEN auto THEN 'AUTO_MATCHED' ELSE 'NEEDS_REVIEW' END AS outcome FROM decided)"""
AUDIT = "(('0x' || substring(sha256(doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296e0 < 0.02e0)"
FINAL = f"""
claims AS (SELECT *, outcome = 'AUTO_MATCHED' AND {AUDIT} AS audited, outcome = 'AUTO_MATCHED' AND NOT {AUDIT} AS claim FROM outcomes),
finals AS (SELECT *, claim AND row_number() OVER (PARTITION BY tx_id, claim ORDER BY received_at, doc_id) = 1 AS wins FROM claims)"""
PREDICTIONS = """
predictions AS (
    SELECT d.doc_id, (d.n_chars % 1001)::DOUBLE / 1000e0 AS score, l.quality = 1 AS correct, (d.n_chars % 1001)::DOUBLE / 1000e0 >= 0.82e0 AS auto_matched,
        nullif(d.n_chars % 7, 0)::INTEGER AS rank_of_correct
    FROM documents d JOIN labels l USING (doc_id))"""


def chain(*parts: str) -> str:
    return "WITH " + ",".join(parts)


TO_DOCS = (LEDGER, RECEIPTS)
TO_PAIRS = (*TO_DOCS, PAIRS)
TO_NAMES = (*TO_DOCS, NAMES)
TO_SCORED = (*TO_DOCS, NAMES, PAIRS, FREQUENT, SCORED)
TO_RANKED = (*TO_SCORED, RANKED)
TO_OUTCOMES = (*TO_RANKED, OUTCOMES)
TO_FINAL = (*TO_OUTCOMES, FINAL)
