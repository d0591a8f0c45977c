"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, load, per_batch, small_batches
from ledgerloom.llm.labelled import FIT_ROWS, held_out, sample

#: Entries of the lexicon, the documents an entry needs, and the evidence (in nats) that it is no chance.
LEXICON, LEAST_DOCS, LEAST_EVIDENCE = 4096, 5, 14.0
#: Beginnings of words that may be entries, by length.
STEMS = (4, 5, 6)
NEAR = 4

#: Second-person words of the four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine deinen euch euer eure ihr "
    "ti tuyo tuya tus usted ustedes vosotros vuestro vuestra os".split())
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})

WORD = re.compile(r"\S+")
EDGE = "\"'“”‘’«»()[]{}<>.,;:!?¡¿*_~-–—…%&#$|/\\+="
INNER = re.compile(r"[^\w]|_")
SPELT = re.compile(r"(?:(?<!\w)\w[ .\-*_]){3,}\w(?!\w)")
REPEATED = re.compile(r"([^\W\d_])\1\1")
#: A spelt-out word has two letters on their own one after the other: these find where in a token they can be.
ALONE_FIRST, ALONE_LAST, ALONE_INSIDE = re.compile(r"\w(?!\w)"), re.compile(r"(?<!\w)\w$"), re.compile(r"(?<!\w)\w[.\-*]\w")


def keys(word: str) -> list[str]:
    """The lexicon keys of a bare lower-case word: itself and its beginnings."""
    return [word, *(f"{word[:n]}^" for n in STEMS if len(word) > n)]


def bare(token: str) -> str:
    return token.strip(EDGE).lower()


def plain(token: str) -> str:
    """The word behind a disguise: digits and signs read as letters, inner signs and repeated letters left out."""
    word = INNER.sub("", token.strip("\"'“”‘’«»()[]{}<>.,;:?¡¿-–—…").rstrip("!").lower().translate(DISGUISE))
    return re.sub(r"(.)\1{2,}", r"\1", word)


def near_by(places: list[int], others: list[int], most: int) -> int:
    """How many of ``places`` have one of ``others``, both in order, within ``most``."""
    if not places or not others:
        return 0
    at, known = np.array(places), np.array(others)
    after = np.searchsorted(known, at)
    gap = np.minimum(np.abs(at - known[np.maximum(after - 1, 0)]), np.abs(known[np.minimum(after, len(known) - 1)] - at))
    return int((gap <= most).sum())


def weight_of(word: str, lexicon: dict[str, float]) -> float | None:
    """The largest entry of a bare word, if it has any."""
    found = [lexicon[k] for k in keys(word) if k in lexicon] if word else []
    return max(found) if found else None


class Tokens:
    """What features take of a token, looked at once for each distinct one: a number in each of these columns.

    ``spells`` is 1 where a letter on its own begins the token, 2 where one ends it, 4 where two follow each other in it.
    """

    COLUMNS = ("weight", "word", "whole", "person", "capitals", "disguised", "hidden", "repeated", "letters", "upper", "spells")
    MOST = 300_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.forget()

    def forget(self) -> None:
        self.number, self.words, self.table = {}, {}, np.zeros((1024, len(self.COLUMNS)))

    def row(self, token: str) -> tuple:
        word, lexicon = bare(token), self.lexicon
        weight = weight_of(word, lexicon)
        odd = not token.isalpha()
        alpha = any(map(str.isalpha, token)) if odd else True
        disguised = odd and alpha and bool(weight is None and INNER.search(token.strip(EDGE)) or any(map(str.isdigit, token)))
        hidden = disguised and any(k in lexicon for k in keys(plain(token)))
        spells = (1 if ALONE_FIRST.match(token) else 0) + (2 if ALONE_LAST.search(token) else 0) + (4 if ALONE_INSIDE.search(token) else 0)
        return (
            weight if weight is not None else 0.0, self.words.setdefault(word, len(self.words)) if weight is not None else -1, word in lexicon, word in SECOND_PERSON,
            len(token) > 1 and token.isupper(), disguised, hidden, bool(REPEATED.search(token)), sum(map(str.isalpha, token)), sum(map(str.isupper, token)), spells)

    def __call__(self, tokens: list[str]) -> np.ndarray:
        """The numbers of the tokens, to look up in the table's columns."""
        if len(self.number) > self.MOST:
            self.forget()
        for token in set(tokens).difference(self.number):
            at = self.number[token] = len(self.number)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at] = self.row(token)
        return np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))


def features(text: str, known: Tokens | dict[str, float]) -> list[float]:
    """Dense features of a text, by known tokens or a lexicon; a text without words has zeros."""
    known = Tokens(known) if isinstance(known, dict) else known
    tokens = text.split()
    n = len(tokens)
    at = known(tokens)
    own, times = np.unique(at, return_counts=True)
    weight, word, whole, person, capitals, disguised, hidden, repeated, letters, upper, spells = known.table[own].T
    sums = lambda column: int(times @ column)
    hits = np.zeros(0)
    close = whole_hits = 0
    met = word >= 0
    if met.any():
        hit = known.table[at, 1] >= 0
        places = np.flatnonzero(hit)
        hits = known.table[at[places], 0]
        whole_hits = int(known.table[at[places], 2].sum())
        if person.any():
            close = near_by(places.tolist(), np.flatnonzero(known.table[at, 3]).tolist(), NEAR)
    words = {w: v for w, v in zip(word[met].tolist(), weight[met].tolist(), strict=True)}
    spelt = 0
    if (spells >= 4).any() or ((spells.astype(int) & 2) > 0).any() and ((spells.astype(int) & 1) > 0).any():
        each = known.table[at, 10].astype(int)
        if (each >= 4).any() or ((each[:-1] & 2) > 0)[(each[1:] & 1) > 0].any():
            spelt = len(SPELT.findall(text))
    letter, marks, total = sums(letters), text.count("!"), sum(hits.tolist())
    asks = text.count("?")
    per, few = max(n, 1), max(len(hits), 1)
    return [
        len(hits), len(hits) / per, len(words), len(set(word[met & (whole > 0)].tolist())), whole_hits / per, total, total / per,
        max(words.values(), default=0.0), close, close / few, sums(person) / per,
        sums(upper) / max(letter, 1), sums(capitals) / per, marks / per, asks / per, marks + asks,
        (len(text) - letter - text.count(" ")) / max(len(text), 1),
        int(disguised.sum()) / per, sums(hidden), sums(hidden) / per, spelt, int(repeated.sum()) / per, math.log1p(n), letter / per,
    ]


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Words and beginnings of words that toxic documents have more often than chance explains, with log odds ratios.

    Documents are counted in Spark; only the ``size`` entries of most evidence come to the driver.
    """

    def counting():
        def one(batch: pa.RecordBatch):
            count: Counter = Counter()
            for text, target in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist(), strict=True):
                own = {k for w in {bare(t) for t in WORD.findall(text)} if 2 < len(w) <= 40 for k in keys(w)}
                count.update((k, target) for k in own)
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in count], pa.string()), pa.array([t for _, t in count], pa.int32()), pa.array(list(count.values()), pa.int64()),
            ], ["key", "target", "n"])

        return one

    totals = {r["target"]: r["count"] for r in rows.groupBy("target").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return {}
    base = toxic / (toxic + clean)
    counts = rows.select("text", "target").mapInArrow(per_batch(counting), "key string, target int, n long").groupBy("key").agg(
        F.sum(F.when(F.col("target") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("n"))
    rate = F.col("a") / F.col("n")
    evidence = F.col("a") * F.log(rate / base) + F.when(
        rate < 1, (F.col("n") - F.col("a")) * F.log((1 - rate) / (1 - base))).otherwise(0)
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("a") + 0.5) / (clean + 1))
    best = counts.where((F.col("a") >= LEAST_DOCS) & (rate > 0.5)).select("key", evidence.alias("evidence"), odds.alias("odds"))
    best = best.where(F.col("evidence") >= LEAST_EVIDENCE).orderBy(F.desc("evidence"), "key").limit(size)
    return {r["key"]: float(r["odds"]) for r in best.collect()}


@dataclass
class Boosted:
    """Gradient-boosted trees of one depth, for the logistic loss; leaves and splits lie in flat arrays."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    start: float
    depth: int

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: int = 10) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score, trees = np.full(len(y), start), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, hessian = y - p, p * (1 - p)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, bins + 1)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                for f in range(x.shape[1]):
                    place = (node - first) * (bins + 1) + binned[:, f]
                    size = width * (bins + 1)
                    g = np.bincount(place, gradient, size).reshape(width, -1).cumsum(1)
                    h = np.bincount(place, hessian, size).reshape(width, -1).cumsum(1)
                    k = np.bincount(place, minlength=size).reshape(width, -1).cumsum(1)
                    gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                    gain[(k < least) | (k[:, -1:] - k < least)] = 0
                    at = gain.argmax(1)
                    value = gain[np.arange(width), at]
                    better = value > best
                    best[better] = value[better]
                    feature[first : first + width][better] = f
                    cut[first : first + width][better] = at[better]
                node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**depth - 1)
            value = rate * np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, hessian, 2**depth) + ridge)
            score += value[leaf]
            trees.append((feature, cut, value))
        return cls(edges, trees, start, depth)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the rows."""
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            score += value[node - (2**self.depth - 1)]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the middle score and the smoothed rate of each block, both rising."""
    blocks: list[list[float]] = []  # sum of y, rows, sum of scores
    for at in np.unique(score):
        own = score == at
        blocks.append([float(y[own].sum()), float(own.sum()), float(score[own].sum())])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    middle = np.array([s / n for _, n, s in blocks])
    rate = np.array([(s + 0.01) / (n + 0.02) for s, n, _ in blocks])
    return middle, np.maximum.accumulate(rate)


@dataclass
class Toxicity:
    """What scoring a text takes. Without a label of each kind there are no trees, and all scores are ``prior``."""

    lexicon: dict[str, float]
    trees: Boosted | None
    middle: np.ndarray
    rate: np.ndarray
    prior: float

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        known = self.__dict__.setdefault("known", Tokens(self.lexicon))  # of this worker
        x = np.array([features(t, known) for t in texts], np.float64)
        return np.clip(np.interp(self.trees(x), self.middle, self.rate), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Toxicity:
    """Learn from at most ``fit_rows`` labelled documents outside the held-out fold; their features alone reach the driver."""
    small_batches(docs.sparkSession)
    rows = sample(docs, labels, target, id_col, text_col, fit_rows)
    lexicon = learn_lexicon(rows.where("not calibrates"))
    width = len(features("", Tokens({})))

    def describing():
        known = Tokens(lexicon)

        def one(batch: pa.RecordBatch):
            x = np.array([features(t, known) for t in batch.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), pa.list_(pa.float64())), batch.column("target"), batch.column("calibrates")], ["x", "target", "calibrates"])

        return one

    table = rows.mapInArrow(per_batch(describing), "x array<double>, target int, calibrates boolean").toPandas()
    y = table["target"].to_numpy(np.float64)
    prior = float((y.sum() + 0.5) / (len(y) + 10))
    if len(np.unique(y)) < 2:
        return Toxicity(lexicon, None, np.zeros(0), np.zeros(0), prior)
    x = np.stack(table["x"].to_list()).reshape(len(y), width)
    apart = table["calibrates"].to_numpy(bool)
    if len(np.unique(y[~apart])) < 2 or len(np.unique(y[apart])) < 2:
        apart = np.zeros(len(y), bool)  # too few labels to set any apart: calibrate on what was learnt from
    trees = Boosted.fit(x[~apart], y[~apart])
    middle, rate = isotonic(trees(x[apart] if apart.any() else x), y[apart] if apart.any() else y)
    return Toxicity(lexicon, trees, middle, rate, prior)


def scored(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted (score >= threshold), by any model of texts.

    Null counts as empty, and empty texts get the score of their features; a null id is in no fold. The texts' own
    length bounds a worker's memory. Columns other than id and text are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def scoring():
        score = shared.value

        def one(batch: pa.RecordBatch):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(score(batch.column("text").to_pylist()), pa.float64())], ["id", "score"])

        return one

    rows = id_and_text(docs, id_col, text_col)
    out = rows.mapInArrow(per_batch(scoring), f"id {dict(rows.dtypes)['id']}, score double")
    return out.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def only(docs: DataFrame, model, accept: int, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns in their order, for which the model's prediction is ``accept``; nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def choosing():
        score = shared.value

        def one(batch: pa.RecordBatch):
            texts = batch.column(text_col).to_pylist()
            mask = (score([t or "" for t in texts]) >= threshold).astype(int) == accept
            yield batch.filter(pa.array(mask))

        return one

    return docs.mapInArrow(per_batch(choosing), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return scored(docs, fit(docs, load(spark, sf_dir, "labels")))
