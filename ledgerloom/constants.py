"""Weights, thresholds and windows of the matcher, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Matcher:
    """Fixed values of the matching rules."""

    weight_amount: float = 0.30
    weight_date: float = 0.20
    weight_merchant: float = 0.25
    weight_card: float = 0.25
    review: float = 0.55
    display: float = 0.35
    auto: float = 0.82
    gap: float = 0.12
    min_coverage: float = 0.70
    min_signals: int = 3
    absolute_tolerance: int = 100
    relative_tolerance: float = 0.002
    tip: float = 0.30
    overshoot: float = 0.02
    overshoot_score: float = 0.9
    near_days: int = 3
    max_days: int = 14
    safety_days: int = 30
    timezone: str = "Asia/Riyadh"
    hard_contradiction: float = 0.80
    contradiction_factor: float = 0.35
    identifier_floor: float = 0.97
    identifier_from: float = 0.70
    merchant_rarity: float = 0.02
    merchant_rarity_from: float = 0.6
    amount_rarity: float = 0.01
    amount_rarity_from: float = 0.8
    received_reliability: float = 0.25
    top: int = 5
    block_cap: int = 200
    min_extraction: float = 0.3
    audit_rate: float = 0.02
    timeout_seconds: int = 15
    assignment_minimum: float = 0.55
    version: str = "heuristic-v2"


MATCHER = Matcher()

#: Words that say nothing about a merchant. One of them never meets its folded spelling; it is kept as it is.
NOISE_TOKENS = (
    "ST STR STA STATION STATIONS STORE STORES BR BRANCH CO LTD LLC INC POS PLC THE AND OF FOR "
    "RUH JED DMM MED MEC AHD KHR TAI محطة فرع شركة مؤسسة").split()
#: City names in the order in which they are looked for.
CITIES = [("RIYADH", "RUH|RIYADH", "الرياض"), ("JEDDAH", "JED|JEDDAH", "جدة"), ("DAMMAM", "DMM|DAMMAM", "الدمام"), ("MADINAH", "MED|MADINAH", "المدينة")]
#: Latin spelling of Arabic letters; the first five take two letters, hamza none.
TWO_LETTERS = {"ث": "TH", "خ": "KH", "ذ": "TH", "ش": "SH", "غ": "GH"}
ONE_LETTER = ("ابتجحدرزسصضطظعفقكلمنهوية" + "ء", "ABTJHDRZSSDTZAFQKLMNHWYH")
#: Arabic-Indic digits, and the letters that are folded into one another.
ARABIC_DIGITS = ("٠١٢٣٤٥٦٧٨٩", "0123456789")
FOLDED = ("إأآٱىؤئ", "اااايوي")

IDENTIFIERS = ("vatNumber", "invoiceNumber", "authorizationCode")
CORE_SIGNALS = ("amount", "date", "merchant", "cardLast4")

#: Marks and tatweel that spellings leave out, and what is no letter, digit or space, as patterns.
MARKS = "[\u0300-\u036f\u064b-\u065f\u0670\u06d6-\u06ed\u0640]"
NO_LETTER = "[^A-Z0-9\u0600-\u06ff\\s]"
