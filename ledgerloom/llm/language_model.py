"""Language-model scores: interpolated modified Kneser-Ney n-grams, counted in Spark, kept as sorted hash arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, load, remainder, small_batches
from ledgerloom.llm.hash_tables import Shards, Store, shard_of, shards_for
from ledgerloom.llm.shingles import mixed
from ledgerloom.scratch import drop, shuffles_dropped, written

FOLDS, HELD_OUT = 7, 2
#: Hashes of the end of a document, which is a token, and of its start, which is a context only.
END, START = np.uint64(1), np.uint64(2)
#: Words of an n-gram.
ORDER = 3
#: Tokens whose n-grams a task sums up before it hands them on.
HOLD = 5_000_000
#: Words that are numbered by how frequent they are among the n-grams handed to a shard: one for so many n-grams, and no more than these.
FREQUENT_EACH, FREQUENT = 64, 4096
#: Words that have a number of their own wherever n-grams are handed on, and about how many bytes of text these are chosen from.
COMMON, COMMON_BYTES = 1 << 17, 16 << 20
#: Bytes of text whose n-grams one shard holds, so that a shard stays of one size as the corpus grows.
SHARD_BYTES = 32 << 20


def tokens(text: bytes) -> list[bytes]:
    """Runs of bytes other than ASCII white space; A-Z in lower case. The end token is not among them."""
    return text.lower().split()


def word_hashes() -> Callable[[list[bytes]], np.ndarray]:
    least = np.uint64(3)  # lower ones are END and START
    return lambda words: np.maximum(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), least)


def extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context and the word after it; the empty context is 0."""
    return mixed(context * np.uint64(0x9E3779B97F4A7C15) + word)


def hash_of(words: Iterable[np.ndarray], size: int) -> np.ndarray:
    """Hash of n-grams, a column for each place; zeros for none."""
    out = np.zeros(size, np.uint64)
    for column in words:
        out = extended(out, column)
    return out


def longer(runs_: np.ndarray, at: np.ndarray, words: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of words that are a word longer: the hashes of the run before and of the longer one, and each place's number.

    ``runs_`` and ``words`` are hashes, ``at`` and ``column`` have each place's number among them.
    """
    each, place = np.unique(at * len(words) + column, return_inverse=True)
    before = runs_[each // len(words)]
    return before, extended(before, words[each % len(words)]), place


def grams(documents: list[np.ndarray], order: int, start: np.unsignedinteger = START, end: np.unsignedinteger = END) -> list[np.ndarray]:
    """Columns of all n-grams that end in a token, document after document; each begins with ``start`` as often as it takes."""
    pad, last = np.full(order - 1, start), np.array([end])
    flat = np.concatenate([part for words in documents for part in (pad, words, last)] or [last[:0]])
    sizes = np.array([len(words) + order for words in documents], np.int64)
    place = np.ones(len(flat), bool)
    starts = np.cumsum(sizes) - sizes
    for i in range(order - 1):
        place[starts + i] = False
    last = np.flatnonzero(place)
    return [flat[last - (order - 1 - i)] for i in range(order)]


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where in it each distinct one starts."""
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def planes(array: np.ndarray) -> bytes:
    """An array of small numbers as bytes that compress well: all lowest bytes first."""
    array = array.astype(np.uint8 if not len(array) or array.max() < 1 << 8 else np.uint16 if array.max() < 1 << 16 else np.uint32 if array.max() < 1 << 32 else np.uint64)
    raw = array.view(np.uint8).reshape(len(array), array.itemsize).T.tobytes()
    return array.itemsize.to_bytes(1, "little") + raw


def within_runs(columns: list[np.ndarray], place: int) -> np.ndarray:
    """Where sorted rows are like the row before in all columns left of ``place``."""
    same = np.ones(len(columns[0]), bool)
    same[:1] = False
    for column in columns[:place]:
        same[1:] &= column[1:] == column[:-1]
    return same


def packed(known: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray], common: int = 0, code: np.ndarray | None = None) -> bytes:
    """N-grams, as numbers of ``known`` words, and their values as bytes: the words that they hold, then small numbers.

    Of ``code``, each known word has its number among the ``common`` words, which aren't written, or -1. Of the others, the
    most frequent have the lowest numbers, the rest are in order; the n-grams are sorted by these, and of both only steps
    from row to row are kept.
    """
    flat, rows = np.concatenate(columns), len(columns[0])
    number = np.full(len(flat), -1) if code is None else code[flat].astype(np.int64)
    own = np.flatnonzero(number < 0)
    used, place, times = np.unique(flat[own], return_inverse=True, return_counts=True)
    frequent = np.argsort(-times, kind="stable")[: min(FREQUENT, rows // FREQUENT_EACH)]
    by = np.concatenate([frequent, np.delete(np.arange(len(used)), frequent)])
    rank = np.empty(len(used), np.int64)
    rank[by] = np.arange(common, common + len(used))
    number[own] = rank[place]
    columns = np.split(number, len(columns))
    bits = (common + len(used)).bit_length()
    if bits * len(columns) < 64:
        place = columns[0].copy()
        for column in columns[1:]:
            place = (place << bits) | column
        order = np.argsort(place)
    else:
        order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    steps = [np.where(within_runs(columns, i), np.diff(c, prepend=0), c) for i, c in enumerate(columns)]
    words = known[used[by]]
    words[len(frequent) + 1 :] = np.diff(words[len(frequent) :])
    parts = [words.view(np.uint8).reshape(-1, 8).T.tobytes(), *map(planes, steps), *(planes(v[order]) for v in values)]
    sizes = np.array([len(columns), len(used), len(order), *map(len, parts)], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(sizes)).tobytes() + sizes.tobytes() + b"".join(parts))


def unpacked(blob: bytes) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """What ``packed`` was given, in another order: numbers are of the common words first, then of the words returned."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, int(np.frombuffer(raw, np.int64, 1)[0]), 8)
    at, numbers = 8 + 8 * len(sizes), []
    words, distinct, rows = sizes[:3].tolist()
    known = np.frombuffer(raw, np.uint8, 8 * distinct, at).reshape(8, distinct).T.copy().view(np.uint64).reshape(distinct)
    frequent = min(FREQUENT, rows // FREQUENT_EACH)
    known[frequent:] = np.cumsum(known[frequent:])
    at += int(sizes[3])
    for size in sizes[4:].tolist():
        width = raw[at]
        numbers.append(np.frombuffer(raw, np.uint8, size - 1, at + 1).reshape(width, rows).T.copy().view(f"<u{width}").reshape(rows))
        at += size
    columns: list[np.ndarray] = []
    for i, steps in enumerate(numbers[:words]):
        starts = np.flatnonzero(~within_runs(columns or [steps], i))
        total = np.cumsum(steps, dtype=np.int64)
        columns.append(total - np.repeat(total[starts] - steps[starts], np.diff(np.append(starts, rows))))
    return known, [c.astype(np.uint32) for c in columns], [v.astype(np.uint32 if v.itemsize <= 4 else np.int64) for v in numbers[words:]]


def merged(parts: list[tuple], common: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Unpacked n-grams of several tasks with one list of words, the common ones first; ``parts`` is emptied."""
    known = np.unique(np.concatenate([k for k, _, _ in parts]))
    columns = [[] for _ in parts[0][1]]
    values = [[] for _ in parts[0][2]]
    while parts:
        own, numbers, counts = parts.pop()
        place = np.arange(len(common) + len(own), dtype=np.uint32)
        place[len(common) :] = np.searchsorted(known, own) + len(common)
        for into, column in zip(columns, numbers, strict=True):
            into.append(place[column])
        for into, column in zip(values, counts, strict=True):
            into.append(column)
    return np.concatenate([common, known]), [np.concatenate(columns.pop(0)) for _ in range(len(columns))], [np.concatenate(values.pop(0)) for _ in range(len(values))]


def dealt(known: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray], shards: int, common: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Distinct n-grams by the shard of their context: all of one context are in one."""
    code = np.full(len(known), -1, np.int32)
    if len(common):
        sorter = np.argsort(common)
        place = sorter[np.minimum(np.searchsorted(common, known, sorter=sorter), len(common) - 1)]
        code = np.where(common[place] == known, place, -1).astype(np.int32)
    shard = shard_of(hash_of((known[c] for c in columns[:-1] or columns), len(columns[0])), shards).astype(np.uint16 if shards <= 1 << 16 else np.uint32)
    order = np.argsort(shard, kind="stable")
    sorted_ = shard[order]
    edges = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else []
    for own in np.split(order, edges[1:]) if len(order) else []:
        yield int(shard[own[0]]), packed(known, [c[own] for c in columns], [v[own] for v in values], len(common), code)


@dataclass
class Totals:
    """Sums over the corpus: tokens, distinct tokens, distinct pairs, the discounts of each order's counts from 1 on,
    and the share of single words' probability that their discounts leave."""

    tokens: int
    distinct: int
    pairs: int
    discounts: list[np.ndarray]
    freed: float


def discounts(times: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and more, from how many counts are 1, 2, 3 and 4.

    Where a corpus is too small for the estimate, the discount is half a count, less for none.
    """
    n = times.astype(np.float64)
    out = np.array([0, 0.5, 0.75, 1.0])
    if (n > 0).all():
        y = n[0] / (n[0] + 2 * n[1])
        estimate = np.array([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
        within = (estimate[1:] > 0) & (estimate[1:] < [1, 2, 3])
        out[1:] = np.where(within, estimate[1:], out[1:])
    return out


def common_words(rows: DataFrame, size: int) -> np.ndarray:
    """Hashes of words that are frequent in some 16 MB of the texts, of ``size`` bytes, the most frequent first.

    They only choose which words take less room on their way between tasks: n-grams and counts are of all texts.
    """

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            words = [hashes(tokens(text)) for text in batch.column("text").to_pylist()]
            found, count = np.unique(np.concatenate([np.tile([START, END], len(words)), *words]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count)], ["word", "n"])

    some = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(-(-size // COMMON_BYTES) or 1)) == 0)
    counts = some.select(F.col("text").cast("binary").alias("text")).mapInArrow(counting, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") > 1).orderBy(F.desc("n"), "word").limit(COMMON).collect()
    return np.array([row["word"] for row in top], np.int64).view(np.uint64)


def corpus_counts(rows: DataFrame, shards: int, order: int, common: np.ndarray) -> DataFrame:
    """``(shard, blob)``: each task's n-grams with their counts, by shard of their context."""

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = word_hashes(), [], 0

        def out() -> pa.RecordBatch:
            known, number = np.unique(np.concatenate([*held, np.array([START, END])]), return_inverse=True)
            number = np.split(number.astype(np.uint32), np.cumsum([len(words) for words in held]))
            columns = grams(number[:-1], order, *number[-1])
            by, starts = runs(hash_of((known[c] for c in columns), len(columns[0])))
            count = np.diff(np.append(starts, len(by)))
            by = by[starts]
            found = list(dealt(known, [c[by] for c in columns], [count], shards, common))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], ["shard", "blob"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(hashes(tokens(text)))
                size += len(held[-1]) + 1
                if size >= HOLD:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return rows.select(F.col("text").cast("binary").alias("text")).mapInArrow(counting, "shard int, blob binary")


def level_of(store: Store, level: int, order: int, shards: int, common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What writes a shard's n-grams of ``level`` words and their contexts, and hands on the ends of the n-grams.

    An n-gram's count is how often it occurs, below the highest order how many different words it follows. Handed on are
    n-grams of a word less, each with how many it ends here and how much more often. Sums over the corpus are handed on as shard -1:
    for each level the counts that are 1, 2, 3 and 4 and all, then all tables written, then all tokens.
    """

    def writing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, sums = 0, [], np.zeros(5 * order + 2, np.int64)
        for batch in batches:
            for number, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                shard = number
                if number < 0:
                    sums += np.frombuffer(blob, np.int64)
                else:
                    parts.append(unpacked(blob))
        batch = blob = None  # what was read isn't held on to
        out: list[tuple[int, bytes]] = []
        if parts:
            words, columns, values = merged(parts, common)
            key = hash_of((words[c] for c in columns), len(columns[0]))
            # A shard is a range of these hashes: mixed once more, they differ in their upper bits again.
            key = mixed(key) if level == 1 else key
            by, starts = runs(key)
            first = by[starts]
            count, *often = (np.add.reduceat(v[by], starts, dtype=np.int64) for v in values)
            often = count + often[0] if often else count
            key, columns = key[first], [c[first] for c in columns]
            del by, first, values
            if level == 1:
                sums[-2] += store.put("grams-1", shard, key, often, count)
                sums[-1] += often.sum()
            else:
                sums[-2] += store.put(f"grams-{level}", shard, key, count)
                context = mixed(hash_of((words[c] for c in columns[:-1]), len(key)))
                by, starts = runs(context)
                each = count[by]
                of = np.stack([np.add.reduceat(v, starts, dtype=np.int64) for v in (each, each == 1, each == 2, each > 2)], 1)
                more = (of[:, 0] > 1) | (of[:, 1] != 1)  # a context not kept was seen once
                sums[-2] += store.put(f"contexts-{level}", shard, context[by[starts]][more], *of[more].T)
                del context, each, of
                columns = columns[1:]
                by, starts = runs(hash_of((words[c] for c in columns), len(key)))
                columns = [c[by[starts]] for c in columns]
                ends = np.diff(np.append(starts, len(by)))
                out += dealt(words, columns, [ends, np.add.reduceat(often[by], starts) - ends], shards, common)
            sums[5 * (level - 1) : 5 * level] += [*np.bincount(np.minimum(count, 5), minlength=6)[1:5], len(count)]
        out.append((-1, sums.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["shard", "blob"])

    return writing


def train(rows: DataFrame, shards: int, order: int, common: np.ndarray) -> tuple[Store, Totals]:
    """Count ``(id, text)`` rows, from the longest n-grams to single words.

    N-grams are summed by shards of their context's hash. A task hands on each n-gram once, so a context's rows in its
    shard are as many as the tasks' different words after it, however often it occurs. What is handed on is written before
    the next level reads it, so that each level's shuffle is deleted before the next begins.
    """
    store = Store(rows.sparkSession, "language-model")
    handed, read = corpus_counts(rows, shards, order, common), None
    for level in range(order, 0, -1):
        handed = handed.groupBy("shard").applyInArrow(level_of(store, level, order, shards, common), "shard int, blob binary")
        if level > 1:
            handed, before = written(handed, "n-grams"), read
            if before is not None:
                drop(before)
            read = handed

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(5 * order + 2, np.int64)
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                sums += np.frombuffer(blob, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["blob"])

    # A row of a few numbers for each task.
    each = handed.select("blob").mapInArrow(summed, "blob binary").collect()
    drop(read)
    sums = np.sum([np.zeros(5 * order + 2, np.int64), *(np.frombuffer(row["blob"], np.int64) for row in each)], axis=0)
    store.seal(shards, int(sums[-2]))
    levels = sums[:-2].reshape(order, 5)
    of_words = discounts(levels[0, :4])
    pairs, distinct = int(levels[1, 4]), int(levels[0, 4])
    freed = float(of_words[1:] @ [levels[0, 0], levels[0, 1], distinct - levels[0, 0] - levels[0, 1]]) / max(pairs, 1)
    return store, Totals(int(sums[-1]), distinct, pairs, [of_words, *map(discounts, levels[1:, :4])], freed)


def probabilities(counts: list[np.ndarray], contexts: list[np.ndarray], known: list[np.ndarray], totals: Totals) -> np.ndarray:
    """Probability of each token: for each order, its n-gram's count, its context's row, and whether that was seen.

    Orders are interpolated with what their discounts leave: the highest with the share of words that an n-gram of one
    word less follows, and so on; single words with one part in V + 1 for each of the V known tokens and for all others.
    """
    even = 1 / (totals.distinct + 1)
    if not totals.pairs:
        return np.full(len(counts[0]), even)
    out = np.maximum(counts[0] - totals.discounts[0][np.minimum(counts[0], 3)], 0) / totals.pairs + totals.freed * even
    for count, context, seen, d in zip(counts[1:], contexts, known, totals.discounts[1:], strict=True):
        free = context[:, 1:] @ d[1:]
        both = (np.maximum(count - d[np.minimum(count, 3)], 0) + free * out) / context[:, 0]
        out = np.where(seen, both, out)
    return out


class Model:
    """Lookups of all orders, for one worker."""

    def __init__(self, store: Store, totals: Totals, shards: int, order: int):
        self.totals, self.order = totals, order
        self.grams = [Shards(store, f"grams-{k}", shards, (0, 0) if k == 1 else (0,)) for k in range(1, order + 1)]
        self.contexts = [Shards(store, f"contexts-{k}", shards, (1, 1, 0, 0)) for k in range(2, order + 1)]

    def __call__(self, documents: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's count and probability; documents start at ``starts``, one after the other.

        What fewer words than all of an n-gram ask for is looked up once for each distinct run of them.
        """
        words, number = np.unique(np.concatenate([*documents, np.array([START, END])]), return_inverse=True)
        number = np.split(number, np.cumsum([len(document) for document in documents]))
        columns = grams(number[:-1], self.order, *number[-1])
        single = hash_of([words], len(words))
        rows = self.grams[0](single, mixed(single))[columns[-1]]
        counts, contexts, known = [rows[:, -1]], [], []
        for k in range(2, self.order + 1):
            context, at = single, columns[self.order - k]
            for column in columns[self.order - k + 1 : -1]:
                _, context, at = longer(context, at, words, column)
            # The context is the n-gram of a word less that ends in the token before.
            before = np.roll(counts[-1] > 0, 1)
            before[starts] = self.totals.tokens > 0
            known.append(before)
            contexts.append(self.contexts[k - 2](context, mixed(context))[at])
            if k < self.order:
                of, key, place = longer(context, at, words, columns[-1])
                counts.append(self.grams[k - 1](of, key)[place, -1])
            else:
                of = context[at]
                counts.append(self.grams[k - 1](of, extended(of, words[columns[-1]]))[:, -1])
        return rows[:, 0], probabilities(counts, contexts, known, self.totals)


def model_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, order: int = ORDER, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model of n-grams of ``order`` words (two or more) learns from the rows that are not held out (null ids are learnt
    from). Tokens are runs of bytes other than ASCII white space, A-Z in lower case, then one end, so an empty or null
    text has one token. Scores are sums of log10 probabilities, base_score of single tokens with one count added. With
    nothing to learn from, all tokens are unknown and share one probability. Every row counts each time it occurs;
    columns other than id and text are not looked at.

    Words and n-grams are known by hashes of 64 bits, of which the stored tables keep 48 within each shard. A shard is a
    range of contexts' hashes; their number follows the bytes of the texts, so that a shard's size doesn't. A table that
    has been lost since it was written is an error.
    """
    if order < 2:
        raise ValueError("order is the number of words of an n-gram, two or more")
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_and_text(docs, id_col, text_col)
    shards = shards_for(rows, shard_bytes)
    if held is None:
        held = F.coalesce(remainder("id", FOLDS) == HELD_OUT, F.lit(False))
    with shuffles_dropped(spark):
        learnt = rows.where(~held)
        store, totals = train(learnt, shards, order, common_words(learnt, shards * shard_bytes))

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, model = word_hashes(), Model(store, totals, shards, order)
        base = np.log10(totals.tokens + totals.distinct + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [hashes(tokens(text)) for text in batch.column("text").to_pylist()]
            sizes = np.array([len(f) + 1 for f in found])
            starts = np.cumsum(sizes) - sizes
            count, probability = model(found, starts)
            sums = (np.add.reduceat(v, starts) for v in ((count > 0).astype(np.int64), np.log10(count + 1) - base, np.log10(probability)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), *map(pa.array, sums)], ["id", "n_tokens", "n_known", "base_score", "score"])

    out = rows.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(
        scoring, f"id {dict(rows.dtypes)['id']}, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        F.col("id").alias(id_col), held.alias("held_out"), "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"),
        "base_score", "score")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_scores(load(spark, sf_dir, "documents"))
