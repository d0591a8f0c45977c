"""Scores of documents and the transactions around them, made where both lie (``around.met``).

Equal to ``scoring.score_pairs`` of the pairs. What depends on one side alone comes as columns that Spark makes once for
each document and transaction; here are the comparisons. Unknown scores are NaN, and null in the results.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ledgerloom.constants import MATCHER as M
from ledgerloom.constants import ONE_LETTER, TWO_LETTERS
from ledgerloom.functions import scoring
from ledgerloom.operators.around import NEVER, alike, distinct, encoded, numbers, spread, whole

IDENTIFIERS = ("vat", "invoice", "auth")
HARD = ("currency", "card", *IDENTIFIERS)
#: Columns of a scored pair beside those of its document and transaction.
SIGNALS = ("s_amount", "s_date", "s_merchant", "s_card", "s_city", "s_branch", "s_vat", "s_invoice", "s_auth", "r_merchant", "r_amount", "alias_score")
SCORES = ("confidence", "decision_confidence", *SIGNALS)
OTHERWISE = {"city": 0.85, "branch": 0.9}
FACTORS = np.array([M.contradiction_factor**n for n in range(len(HARD) + 1)])
LATIN = str.maketrans(TWO_LETTERS | {letter: ONE_LETTER[1][i : i + 1] for i, letter in enumerate(ONE_LETTER[0])})

#: What ``documents`` and ``transactions`` add for the comparisons.
OWN = ["p_amount", "p_day", "p_core", "p_city", "p_branch", "p_bits", *[f"p_{c}" for c in HARD], "w_amount", "w_date", "w_merchant", "w_card", "evidence_coverage"]
OTHER = ["q_day", "q_core", "q_city", "q_branch", "q_tips", *[f"q_{c}" for c in HARD], "q_aliases"]
#: The bits of ``p_bits`` beside those of ``HARD``.
NAMED, RECEIPT = len(HARD), len(HARD) + 1
#: Pairs of names of which a task keeps the score.
KEPT = 1 << 22


def documents(docs: DataFrame) -> DataFrame:
    """Documents with ``OWN`` and signal_bits, from those with core, city and branch of their name. What ``around.met`` knows by itself isn't repeated."""
    fixed = docs.select("*", *[w.alias(f"w_{n}") for n, w in scoring.weights().items()])
    total = F.col("w_amount") + F.col("w_date") + F.col("w_merchant") + F.col("w_card")
    marks = [*map(scoring.hard, HARD), scoring.present(F.col("doc_merchant")), F.coalesce(F.col("doc_type") == "RECEIPT", F.lit(False))]
    return fixed.select(
        "*", scoring.coverage(total).alias("evidence_coverage"), scoring.signal_bits().alias("signal_bits"),
        F.col("doc_amount").cast("double").alias("p_amount"), F.unix_date(scoring.local_date(F.col("doc_date"))).alias("p_day"),
        F.col("doc_core").alias("p_core"), F.col("doc_city").alias("p_city"), F.col("doc_branch").alias("p_branch"),
        functools.reduce(lambda a, b: a + b, [F.when(m, 1 << i).otherwise(0) for i, m in enumerate(marks)]).alias("p_bits"), *[v.alias(f"p_{n}") for n, v in scoring.compared("doc").items()])


def transactions(ledger: DataFrame) -> DataFrame:
    """Transactions with ``OTHER``; ``alias_cores`` are the normalised aliases of each one's merchant, if there are any."""
    listed = F.array_join("alias_cores", "\u0001") if "alias_cores" in ledger.columns else F.lit(None).cast("string")
    return ledger.select(
        "*", F.unix_date(scoring.local_date(F.col("tx_at"))).alias("q_day"),
        F.col("tx_core").alias("q_core"), F.col("tx_city").alias("q_city"), F.col("tx_branch").alias("q_branch"), F.coalesce(scoring.tips("tx_category", "tx_merchant"), F.lit(False)).alias("q_tips"),
        *[v.alias(f"q_{n}") for n, v in scoring.compared("tx").items()], listed.alias("q_aliases"))


def round3(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1000 + 0.5) / 1000


def or_zero(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0.0, x)


def rarity(score: np.ndarray, floor: float, times: np.ndarray) -> np.ndarray:
    out, rows = np.full(len(score), np.nan), np.flatnonzero(score >= floor)
    out[rows] = round3(1.0 / np.sqrt(times[rows].astype(np.float64)))
    return out


class Names:
    """Bigrams and words of names, as numbers; an empty name and none have neither."""

    def __init__(self, names: set[str | None]):
        texts = sorted({n or "" for n in names} | {(n or "").translate(LATIN) for n in names})
        self.number = {text: i for i, text in enumerate(texts)}
        self.latin = np.array([self.number.get(t.translate(LATIN), i) for i, t in enumerate(texts)], np.int64)
        self.empty = np.array([t == "" for t in texts])
        compact = [t.replace(" ", "") for t in texts]
        self.grams = self.parts([Counter(c[i : i + 2] for i in range(len(c) - 1)) for c in compact])
        self.words = self.parts([Counter(set(t.split(" "))) if t else Counter() for t in texts])

    @staticmethod
    def parts(counts: list[Counter]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Where each name's parts start, the parts, how often each occurs, and how many each name has in all."""
        known: dict[str, int] = {}
        part = np.array([known.setdefault(p, len(known)) for c in counts for p in c], np.int64)
        times = np.array([n for c in counts for n in c.values()], np.float64)
        starts = np.append(0, np.cumsum([len(c) for c in counts])).astype(np.int64)
        return starts, part, times, np.array([c.total() for c in counts], np.float64), len(known)

    def of(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode()
        numbers = np.array([self.number[t] for t in coded.dictionary.to_pylist()] + [self.number[""]], np.int64)
        return numbers[coded.indices.fill_null(len(numbers) - 1).to_numpy(zero_copy_only=False)]

    @staticmethod
    def shared(parts: tuple, a: int, b: np.ndarray, marks: np.ndarray) -> np.ndarray:
        starts, part, times, _, _ = parts
        own = slice(starts[a], starts[a + 1])
        marks[part[own]] = times[own]
        owner, at = spread(starts[b], starts[b + 1])
        out = np.bincount(owner, np.minimum(marks[part[at]], times[at]), len(b))
        marks[part[own]] = 0
        return out

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Half the share of common words, half the overlap of bigrams; 1 for equal names, 0 for empty ones."""
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        each, starts = np.unique(a, return_index=True)
        grams, words = np.zeros(len(a)), np.zeros(len(a))
        gram_marks, word_marks = np.zeros(self.grams[4]), np.zeros(self.words[4])
        for name, low, high in zip(each.tolist(), starts.tolist(), [*starts[1:].tolist(), len(a)], strict=True):
            grams[low:high] = self.shared(self.grams, name, b[low:high], gram_marks)
            words[low:high] = self.shared(self.words, name, b[low:high], word_marks)
        x, y = self.grams[3][a], self.grams[3][b]
        jaccard = words / np.maximum(self.words[3][a] + self.words[3][b] - words, 1)
        dice = np.where((x == 0) | (y == 0), 0.0, 2.0 * grams / np.maximum(x + y, 1))
        out = np.empty(len(a))
        out[order] = np.where(self.empty[a] | self.empty[b], 0.0, np.where(a == b, 1.0, 0.5 * jaccard + 0.5 * dice))
        return out

    def kept(self, own: np.ndarray, other: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """``score`` of rows of ``own`` and ``other``, which are names; each pair of names is compared once, if they are few."""
        (few, a), (many, b) = np.unique(own, return_inverse=True), np.unique(other, return_inverse=True)
        a, b = a.reshape(-1) * len(many), b.reshape(-1)
        if len(few) * len(many) > KEPT:
            return lambda d, t: self.score(own[d], other[t])
        known = np.full(len(few) * len(many), np.nan)

        def score(d: np.ndarray, t: np.ndarray) -> np.ndarray:
            key = a[d] + b[t]
            out = known[key]
            new = distinct(key[np.isnan(out)])
            if len(new):
                known[new] = self.score(few[new // len(many)], many[new % len(many)])
                out = known[key]
            return out

        return score

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The better of the names as written and in Latin letters; each pair of names is compared once."""
        key, inverse = np.unique(a * len(self.empty) + b, return_inverse=True)
        a, b = key // len(self.empty), key % len(self.empty)
        best = self.similarity(a, b)
        other = np.flatnonzero((self.latin[a] != a) | (self.latin[b] != b))
        if len(other):
            best[other] = np.maximum(best[other], self.similarity(self.latin[a[other]], self.latin[b[other]]))
        return round3(best)[inverse.reshape(-1)]


def floats(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)


def millis(column: pa.Array) -> np.ndarray:
    """Milliseconds of times in microseconds."""
    micros = numbers(column)
    return np.where(micros == NEVER, np.nan, (micros // 1000).astype(np.float64))


def flags(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False)


def matched_codes(own: pa.Array, other: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of values, equal where they are; null is -1 on either side, and a document's value that no transaction has -2."""
    coded = other.dictionary_encode()
    of_own = pc.if_else(pc.is_null(own), -1, pc.index_in(own, value_set=coded.dictionary).fill_null(-2))
    return of_own.to_numpy(zero_copy_only=False).astype(np.int64), coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def compared(own: pa.Table, pool: pa.Table) -> Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]:
    """A function of candidates, by document: the first of them, their documents and transactions; it gives ``SCORES`` and ``flags``."""
    doc = {c: floats(whole(own, c)) for c in ("p_amount", "p_day", "w_amount", "w_date", "w_merchant", "w_card", "evidence_coverage")} | {"p_millis": millis(whole(own, "_at"))}
    bits = whole(own, "p_bits").to_numpy(zero_copy_only=False).astype(np.int64)
    doc |= {"p_named": bits >> NAMED & 1 == 1, "p_receipt": bits >> RECEIPT & 1 == 1} | {f"h_{c}": bits >> i & 1 for i, c in enumerate(HARD)}
    doc |= {"w_total": doc["w_amount"] + doc["w_date"] + doc["w_merchant"] + doc["w_card"], "w_root": np.sqrt(doc["evidence_coverage"])}
    tx = {"q_amount": floats(whole(pool, "_amount")), "q_millis": millis(whole(pool, "_at")), "q_day": floats(whole(pool, "q_day")), "q_tips": flags(whole(pool, "q_tips"))}
    codes = {c: matched_codes(whole(own, f"p_{c}"), whole(pool, f"q_{c}")) for c in (*HARD, "city", "branch")}
    aliases = whole(pool, "q_aliases").dictionary_encode()
    alias_lists = [t.split("\u0001") for t in aliases.dictionary.to_pylist()]
    core = [whole(own, "p_core"), whole(pool, "q_core")]
    names = Names({*core[0].unique().to_pylist(), *core[1].unique().to_pylist(), *(t for each in alias_lists for t in each), ""})
    doc_name, tx_name = names.of(core[0]), names.of(core[1])
    name_score = names.kept(doc_name, tx_name)
    often_name, often_amount = encoded(core[1]), encoded(whole(pool, "_amount"))
    alias_starts = np.append(0, np.cumsum([len(each) for each in alias_lists])).astype(np.int64)
    alias_names = np.array([names.number[t] for each in alias_lists for t in each], np.int64)
    alias_code = aliases.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def same(field: str, start: int, end: int, d: np.ndarray, t: np.ndarray) -> np.ndarray:
        """1 or 0 where both have the field; few documents have most of them, so only their candidates are looked at."""
        out, own = np.full(len(d), np.nan), codes[field][0]
        if (having := own[start:end] != -1).any():
            rows = np.flatnonzero(having[d - start])
            a, b = own[d[rows]], codes[field][1][t[rows]]
            out[rows] = np.where(b != -1, (a == b).astype(np.float64), np.nan)
        return out

    def through_aliases(d: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = np.full(len(d), np.nan)
        listed = np.flatnonzero(alias_code[t] >= 0)
        if len(listed):
            code = alias_code[t[listed]]
            owner, at = spread(alias_starts[code], alias_starts[code + 1])
            scores = names.score(doc_name[d[listed]][owner], alias_names[at])
            out[listed] = np.maximum.reduceat(scores, np.append(0, np.flatnonzero(np.diff(owner)) + 1))
        return out

    def amount(d: np.ndarray, t: np.ndarray) -> np.ndarray:
        a, b = doc["p_amount"][d], tx["q_amount"][t]
        tolerance = np.maximum(float(M.absolute_tolerance), np.floor(b * M.relative_tolerance + 0.5))
        short, over = (b - a) / b, (a - b) / b
        tip = doc["p_receipt"][d] & tx["q_tips"][t] & (short <= M.tip)
        below = np.where(tip, 1.0 - (short / M.tip) * 0.5, 0.0)
        score = np.where(np.abs(a - b) <= tolerance, 1.0, np.where(a < b, below, np.where(over <= M.overshoot, M.overshoot_score, 0.0)))
        return np.clip(np.where((a <= 0) | (b <= 0), 0.0, score), 0.0, 1.0)

    def date(d: np.ndarray, t: np.ndarray) -> np.ndarray:
        days = np.abs(doc["p_millis"][d] - tx["q_millis"][t]) / 86_400_000.0
        far = np.where(days <= M.max_days, 0.7 - ((days - 3) / 11) * 0.5, 0.0)
        score = np.where(days <= 1, 0.98, np.where(days <= M.near_days, 0.98 - ((days - 1) / 2) * 0.28, far))
        return np.clip(np.where(doc["p_day"][d] == tx["q_day"][t], 1.0, score), 0.0, 1.0)

    def compare(start: int, owner: np.ndarray, t: np.ndarray) -> dict[str, np.ndarray]:
        with np.errstate(all="ignore"):
            d, end = owner + start, start + int(owner.max(initial=-1)) + 1
            found = {f"s_{c}": same(c, start, end, d, t) for c in ("city", "branch", *IDENTIFIERS)}
            a, b = codes["currency"][0][d], codes["currency"][1][t]
            other_currency = (a != -1) & (b != -1) & (a != b)
            has_amount = ~np.isnan(doc["p_amount"][d])
            found["s_amount"] = np.where(has_amount, np.where(other_currency, 0.0, amount(d, t)), np.nan)
            found["s_date"] = np.where(np.isnan(doc["p_millis"][d]), np.nan, date(d, t))
            name = name_score(d, t)
            alias = through_aliases(d, t)
            blended = np.fmax(name, or_zero(alias))
            for c, weight in (("city", 0.15), ("branch", 0.1)):
                if len(rows := np.flatnonzero(~np.isnan(found[f"s_{c}"]))):
                    blended[rows] = OTHERWISE[c] * blended[rows] + weight * found[f"s_{c}"][rows]
            found["s_merchant"] = np.where(doc["p_named"][d], np.clip(blended, 0.0, 1.0), np.nan)
            a, b = codes["card"][0][d], codes["card"][1][t]
            found["s_card"] = np.where(a == -1, np.nan, (a == b).astype(np.float64))

            bits = (has_amount & other_currency) * doc["h_currency"][d]
            for i, c in enumerate(HARD[1:], 1):
                if len(rows := np.flatnonzero(found[f"s_{c}"] == 0)):
                    bits[rows] |= doc[f"h_{c}"][d[rows]] << i
            earned = 0.0
            for c in ("amount", "date", "merchant", "card"):
                earned = earned + or_zero(found[f"s_{c}"]) * doc[f"w_{c}"][d]
            total = doc["w_total"][d]
            base = np.where(total > 0, earned / total, 0.0)
            strong = (found["s_vat"] == 1) | (found["s_invoice"] == 1) | (found["s_auth"] == 1)
            base = np.where(strong & (base >= M.identifier_from), np.maximum(base, M.identifier_floor), base)
            found["r_merchant"] = rarity(found["s_merchant"], M.merchant_rarity_from, alike(owner, often_name[t]))
            found["r_amount"] = rarity(found["s_amount"], M.amount_rarity_from, alike(owner, often_amount[t]))
            base = base + or_zero(M.merchant_rarity * found["r_merchant"])
            base = base + or_zero(M.amount_rarity * found["r_amount"])
            base = base * FACTORS[np.bitwise_count(bits)]
            found["confidence"] = round3(np.clip(base, 0.0, 1.0))
            found["decision_confidence"] = round3(np.clip(base * doc["w_root"][d], 0.0, 1.0))
            return found | {"alias_score": alias, "flags": bits}

    return compare


CONTRADICTIONS = ("currency_mismatch", "card_last4_mismatch", "vatNumber_mismatch", "invoiceNumber_mismatch", "authorizationCode_mismatch")


def contradictions(bits: Column) -> Column:
    """The names of contradictions from ``flags``."""
    every = [F.array(*[F.lit(x) for i, x in enumerate(CONTRADICTIONS) if n >> i & 1]).cast("array<string>") for n in range(1 << len(CONTRADICTIONS))]
    return F.element_at(F.array(*every), bits + 1)


def contradictions_text(bits: Column) -> Column:
    """The same in one text, with commas."""
    return F.element_at(F.array(*[F.lit(",".join(x for i, x in enumerate(CONTRADICTIONS) if n >> i & 1)) for n in range(1 << len(CONTRADICTIONS))]), bits + 1)


FLAGS = StructField("flags", IntegerType())


def score_fields(names: tuple[str, ...]) -> list[StructField]:
    return [StructField(c, DoubleType()) for c in names]


def arrays(found: dict[str, np.ndarray], names: tuple[str, ...], rows: np.ndarray | slice) -> dict[str, pa.Array]:
    return {c: pa.array(found[c][rows], from_pandas=True) for c in names} | {"flags": pa.array(found["flags"][rows], pa.int32())}


def every_pair(doc: list[StructField], tx: list[StructField], scores: tuple[str, ...]) -> tuple[Callable, StructType]:
    """For ``around.met``: a row for each candidate, with columns of both sides, ``scores`` and ``flags``."""

    def made(own: pa.Table, pool: pa.Table) -> Callable:
        compare = compared(own, pool)
        of_tx = {f.name: whole(pool, f.name) for f in tx}

        def make(start: int, some: pa.Table, owner: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            columns = {f.name: whole(some, f.name).take(pa.array(owner)) for f in doc} | {c: v.take(pa.array(at)) for c, v in of_tx.items()}
            columns |= arrays(compare(start, owner, at), scores, slice(None))
            return pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

        return make

    return made, StructType([*doc, *tx, *score_fields(scores), FLAGS])


def best_pairs(doc: list[StructField], tx: list[StructField], top: int, floor: float, scores: tuple[str, ...] = SCORES) -> tuple[Callable, StructType]:
    """For ``around.met``: a row for each document with candidates.

    Beside ``doc``: how many (scoped), the best decision_confidence of all (best), and in ``shown`` the first ``top`` of
    those at or above ``floor``, with ``tx`` columns, ``scores`` and ``flags``.
    """
    entry = StructType([*tx, *score_fields(scores), FLAGS])

    def made(own: pa.Table, pool: pa.Table) -> Callable:
        compare, ids = compared(own, pool), numbers(whole(pool, "_id"))
        of_tx = {f.name: whole(pool, f.name) for f in tx}

        def make(start: int, some: pa.Table, owner: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            found = compare(start, owner, at)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            having, scoped = owner[starts], np.diff(np.append(starts, len(owner)))
            best = np.maximum.reduceat(found["decision_confidence"], starts)
            rows = np.flatnonzero(found["decision_confidence"] >= floor)
            rows = rows[np.lexsort((ids[at[rows]], -found["confidence"][rows], -found["decision_confidence"][rows], owner[rows]))]
            rows = rows[np.arange(len(rows)) - np.searchsorted(owner[rows], owner[rows]) < top]
            columns = {c: v.take(pa.array(at[rows])) for c, v in of_tx.items()} | arrays(found, scores, rows)
            ends = np.append(np.searchsorted(owner[rows], having), len(rows))
            shown = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([*columns.values()], names=[*columns]))
            of_doc = [whole(some, f.name).take(pa.array(having)) for f in doc]
            return pa.RecordBatch.from_arrays([*of_doc, pa.array(scoped, pa.int64()), pa.array(best), shown], names=[*(f.name for f in doc), "scoped", "best", "shown"])

        return make

    return made, StructType([*doc, StructField("scoped", LongType()), StructField("best", DoubleType()), StructField("shown", ArrayType(entry))])
