"""Quality: random-indexing word vectors pooled per document, then a two-layer network with a calibrated temperature."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import Bounded, id_and_text, load, per_batch, small_batches
from ledgerloom.llm.labelled import FIT_ROWS, sample
from ledgerloom.llm.toxicity import scored

#: Words that have vectors, the documents a word needs, the vectors' length, and the places an index vector fills.
VOCABULARY, LEAST_DOCS, SIZE, PLACES = 20_000, 5, 64, 6
#: Neighbours on either side that a word's vector adds up.
WINDOW = 2
#: Tokens whose neighbours are added up at a time, and distinct words that a task counts before it hands them on.
BLOCK, HELD_WORDS = 1 << 19, 500_000
#: What a word's neighbours are counted by: each place, positive and negative, and one for those without a vector.
SLOTS = 2 * SIZE + 1
HIDDEN = 32
THRESHOLD = 0.3
SLICES = 16

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def plane_class(belongs: Callable[[str], bool]) -> str:
    """The characters up to U+FFFF that belong, as a class of ranges, which is matched by one lookup a character."""
    edges = [c for c in range(1 << 16) if belongs(chr(c)) != (c > 0 and belongs(chr(c - 1)))] + [1 << 16]
    return "[" + "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2], strict=False)) + "]"


#: The same tokens in texts without characters beyond U+FFFF.
PLANE_TOKEN = re.compile("|".join(plane_class(kind) + "+" for kind in (
    lambda c: c.isalnum() and not c.isdecimal(), str.isdecimal, lambda c: not (c.isalnum() or c.isspace() or c == "_"))) + "|_+")
BEYOND = re.compile("[\U00010000-\U0010ffff]")


def tokens(text: str) -> list[str]:
    return (TOKEN if BEYOND.search(text) else PLANE_TOKEN).findall(text)


def shape(token: str) -> str:
    """What stands for a word without a vector of its own."""
    if token.isalpha():
        kind = "upper" if token.isupper() and len(token) > 1 else "title" if token[0].isupper() else "lower"
        return f"<{kind} {min(len(token) // 4, 4)}>"
    return "<digits>" if token.isdigit() else f"<signs {token[0]} {min(len(token), 4)}>"


SHAPES = [f"<{kind} {n}>" for kind in ("upper", "title", "lower") for n in range(5)] + ["<digits>"]


def index_vector(word: str) -> np.ndarray:
    """The sparse random vector of a word: a few places of 1 or -1, by the word's hash."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(word))
    out = np.zeros(SIZE, np.float32)
    out[rng.choice(SIZE, PLACES, replace=False)] = rng.choice([-1.0, 1.0], PLACES)
    return out


def slots_of(vocabulary: list[str]) -> np.ndarray:
    """The slots that each word's index vector fills; two last rows for what has no vector and for the gaps between texts."""
    index = np.stack([index_vector(word) for word in vocabulary])
    places = np.argsort(index == 0, axis=1, kind="stable")[:, :PLACES]
    filled = 2 * places + (np.take_along_axis(index, places, 1) < 0)
    return np.concatenate([filled, np.full((2, PLACES), SLOTS - 1)])


class Words:
    """Numbers of a text's tokens: the vocabulary's, or of the shape that stands for others."""

    def __init__(self, vocabulary: list[str]):
        known = {word: i for i, word in enumerate(vocabulary)}
        other = len(vocabulary)
        self.number = Bounded(lambda token: known[token] if token in known else known.get(shape(token), other))

    def __call__(self, text: str) -> tuple[np.ndarray, list[float]]:
        """The numbers, and how often a token is the one before it or the one before that, and the share of distinct ones."""
        found = tokens(text)
        n = max(len(found), 1)
        own = np.fromiter(map(hash, found), np.int64, len(found))  # strings keep theirs, which sets and dicts take too
        again = [float(np.count_nonzero(own[step:] == own[:-step])) / n for step in (1, 2)]
        return self.numbered(found), [*again, len(set(found)) / n]

    def numbers(self, text: str) -> np.ndarray:
        return self.numbered(tokens(text))

    def numbered(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))


def learn_vocabulary(rows: DataFrame, size: int = VOCABULARY) -> list[str]:
    """The words of most documents and all shapes; counted in Spark, ``size`` of them come to the driver."""

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, shaped = Counter(), Bounded(shape)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = {t for t in tokens(text) if len(t) <= 40}
                count.update(own)
                count.update({shaped[t] for t in own if not (t.isalpha() or t.isdigit())} - own)
            if len(count) > HELD_WORDS:
                yield out()
                count.clear()
        yield out()

    counts = rows.select("text").mapInArrow(counting, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    best = counts.where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "word").limit(size)
    return sorted({r["word"] for r in best.collect()} | set(SHAPES))


def learn_vectors(rows: DataFrame, vocabulary: list[str]) -> np.ndarray:
    """Each word's sum of its neighbours' index vectors, at length 1; a last row for what has no vector.

    Sums are made in Spark; what comes to the driver is one table of the vocabulary's size.
    """
    count = len(vocabulary) + 1
    width = -(-count // SLICES)
    shared = rows.sparkSession.sparkContext.broadcast(slots_of(vocabulary))  # six numbers a word

    def adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, numbers, gap = shared.value, Words(vocabulary), np.full(WINDOW, count, np.int64)
        times, seen = np.zeros((count + 1) * SLOTS, np.int64), False

        def add(parts: list[np.ndarray]) -> None:
            ids, other = np.concatenate(parts), count + 1
            for at in range(0, len(ids), BLOCK):
                own = ids[at : at + BLOCK + WINDOW]
                ends = [own[:BLOCK][: len(own) - step] * other + own[step : step + BLOCK] for step in range(1, WINDOW + 1)]
                pairs, often = np.unique(np.concatenate(ends), return_counts=True)
                left, right = np.divmod(pairs, other)
                met = np.concatenate([left[:, None] * SLOTS + slots[right], right[:, None] * SLOTS + slots[left]])
                times[:] += np.bincount(met.reshape(-1), np.tile(np.repeat(often, PLACES), 2), len(times)).astype(np.int64)

        parts, held = [gap], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                parts += numbers.numbers(text), gap
                held, seen = held + len(parts[-2]), True
                if held >= BLOCK:
                    add(parts)
                    parts, held = [gap], 0
        add(parts)
        signed = times.reshape(-1, SLOTS)[:count]
        table = (signed[:, 0:-1:2] - signed[:, 1::2]).astype(np.float32)
        for i in range(SLICES if seen else 0):
            part = table[i * width : (i + 1) * width]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "sums"])

    def summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = 0, 0.0
        for batch in batches:
            for i, sums in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                number, total = i, total + np.frombuffer(sums, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.asarray(total).tobytes()], pa.binary())], ["slice", "sums"])

    schema = "slice int, sums binary"
    table = np.zeros((count, SIZE))
    for part in rows.select("text").mapInArrow(adding, schema).groupBy("slice").applyInArrow(summing, schema).collect():
        sums = np.frombuffer(part["sums"]).reshape(-1, SIZE)
        table[part["slice"] * width : part["slice"] * width + len(sums)] = sums
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(described: tuple[np.ndarray, list[float]], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a text's word vectors, and its repetitions; zeros for a text without tokens."""
    numbers, repeats = described
    if not len(numbers):
        return np.zeros(2 * SIZE + len(repeats), np.float32)
    ids, times = np.unique(numbers, return_counts=True)
    share = (times / len(numbers)).astype(np.float32)
    own = vectors[ids]
    mean = share @ own
    return np.concatenate([mean, np.sqrt(np.maximum(share @ own**2 - mean**2, 0)), np.asarray(repeats, np.float32)])


@dataclass
class Network:
    """Two layers over standardised inputs, and the temperature that its log odds are divided by."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 2e-3, decay: float = 1e-3, seed: int = 8) -> Network:
        rng = np.random.default_rng(seed)
        mean, scale = x.mean(0), x.std(0) + 1e-3
        z = (x - mean) / scale
        w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.array(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in (order[i : i + batch] for i in range(0, len(y), batch)):
                hidden = np.maximum(z[at] @ w[0] + w[1], 0)
                error = (1 / (1 + np.exp(-(hidden @ w[2] + w[3]))) - y[at]) / len(at)
                back = np.outer(error, w[2]) * (hidden > 0)
                gradients = [z[at].T @ back + decay * w[0], back.sum(0), hidden.T @ error + decay * w[2], error.sum()]
                step += 1
                for k, g in enumerate(gradients):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return cls(mean, scale, w[0], w[1], w[2], float(w[3]))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.first + self.first_bias, 0) @ self.second + self.second_bias

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Choose the temperature of the least log loss."""
        raw = self.log_odds(x)
        temperatures = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        losses = [np.mean(np.logaddexp(0, np.where(y > 0, -raw, raw) / t)) for t in temperatures]
        self.temperature = float(temperatures[int(np.argmin(losses))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / self.temperature, -500, 500)))


@dataclass
class Quality:
    """What scoring a text takes. Without a label of each kind there is no network, and all scores are ``prior``."""

    vocabulary: list[str]
    vectors: np.ndarray
    network: Network | None
    prior: float

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "words"}

    def describe(self, texts: list[str]) -> np.ndarray:
        if "words" not in self.__dict__:
            self.__dict__["words"] = Words(self.vocabulary)
        return np.stack([pooled(self.__dict__["words"](t), self.vectors) for t in texts]).astype(np.float64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.full(len(texts), self.prior) if self.network is None else self.network(self.describe(texts))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Quality:
    """Learn word vectors from all documents, and the network from at most ``fit_rows`` labelled ones outside the held-out fold.

    Word vectors are sums made in Spark; of the labelled documents, only their pooled vectors reach the driver.
    """
    small_batches(docs.sparkSession)
    rows = sample(docs, labels, target, id_col, text_col, fit_rows)
    corpus = id_and_text(docs, id_col, text_col)
    vocabulary = learn_vocabulary(corpus)
    model = Quality(vocabulary, learn_vectors(corpus, vocabulary), None, 1.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def describing():
        own = shared.value

        def one(batch: pa.RecordBatch):
            x = own.describe(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), pa.list_(pa.float64())), batch.column("target"), batch.column("calibrates")], ["x", "target", "calibrates"])

        return one

    table = rows.mapInArrow(per_batch(describing), "x array<double>, target int, calibrates boolean").toPandas()
    y = table["target"].to_numpy(np.float64)
    model.prior = float((y.sum() + 9.5) / (len(y) + 10))
    if len(np.unique(y)) < 2:
        return model
    x = np.stack(table["x"].to_list())
    apart = table["calibrates"].to_numpy(bool)
    if len(np.unique(y[~apart])) < 2 or len(np.unique(y[apart])) < 2:
        apart = np.zeros(len(y), bool)  # too few labels to set any apart: calibrate on what was learnt from
    model.network = Network.fit(x[~apart], y[~apart])
    model.network.calibrate(*(x[apart], y[apart]) if apart.any() else (x, y))
    return model


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return scored(docs, fit(docs, load(spark, sf_dir, "labels")), threshold=THRESHOLD)
