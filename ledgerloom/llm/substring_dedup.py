"""Repeated passages: documents joined on winnowed anchors, matches extended both ways, later occurrences removed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import Bounded, join_groups, load, may_be_in, per_batch, small_batches
from ledgerloom.scratch import drop, written

#: Words that a repeat has at least, and words of an anchor.
WINDOW, ANCHOR = 20, 10
#: Words that are looked at together, and bytes of a long text that are cut into words together.
MOST, CHUNK = 1 << 18, 1 << 22
WHITE = re.compile(rb"[ \t\n\x0b\f\r]")


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits spread over all of them."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a sequence of numbers, from sums of the numbers times powers of an odd base."""

    def __init__(self, base: int):
        self.base, self.powers, self.inverse = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def sums(self, numbers: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(numbers):
            powers = lambda x: np.cumprod(np.append(np.ones(1, np.uint64), np.full(len(numbers), x, np.uint64)))
            self.powers, self.inverse = powers(self.base), powers(pow(self.base, -1, 1 << 64))
        return np.append(np.zeros(1, np.uint64), np.cumsum(numbers * self.powers[: len(numbers)]))

    def of(self, sums: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mixed((sums[start + size] - sums[start]) * self.inverse[start])


class Part:
    """Words of some texts, as hashes end to end: segments of ``MOST`` words and those of a last window after them.

    Of each segment: the row of its text, the place of its first word there, and where it begins here.
    """

    def __init__(self, held: list[tuple[int, int, np.ndarray]]):
        self.row, self.first = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
        sizes = np.array([len(x[2]) for x in held], np.int64)
        self.words, self.begins, self.ends = np.concatenate([x[2] for x in held]), np.cumsum(sizes) - sizes, np.cumsum(sizes)


class Reader:
    """Cuts texts into words, and these into parts of bounded size."""

    def __init__(self, window: int):
        self.window, self.known = window, Bounded(xxhash.xxh3_64_intdigest)

    def hashes(self, text: str) -> np.ndarray:
        data, at, out = text.encode(), 0, []
        while at < len(data):
            white = WHITE.search(data, at + CHUNK)
            end = white.start() if white else len(data)
            words = data[at:end].split()
            out.append(np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def parts(self, texts: list[str]) -> Iterator[Part]:
        held, size = [], 0
        for row, text in enumerate(texts):
            words = self.hashes(text)
            for first in range(0, len(words) - self.window + 1, MOST):
                held.append((row, first, words[first : first + MOST + self.window - 1]))
                size += len(held[-1][2])
                if size >= MOST:
                    yield Part(held)
                    held, size = [], 0
        if held:
            yield Part(held)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchored(window: int, anchor: int, whole: bool):
    """Anchors of texts: of each window the ``anchor`` words of the least hash, the first of equal ones.

    One row for each anchor and the windows that chose it, which lie side by side: the anchor's hash ``a`` and, if
    ``whole``, the hash ``c`` of the stretch of all these windows, with the document, the stretch's place and its size.
    """

    def work():
        reader, one, two = Reader(window), Rolling(0x9E3779B97F4A7C15), Rolling(0xD6E8FEB86659FD93)

        def found(part: Part) -> tuple[np.ndarray, ...]:
            sums, places = one.sums(part.words), len(part.words) - window + 1
            least = one.of(sums, np.arange(len(part.words) - anchor + 1), anchor)
            best, offset = least[:places].copy(), np.zeros(places, np.int64)
            for o in range(1, window - anchor + 1):
                own = least[o : o + places]
                less = own < best
                best[less], offset[less] = own[less], o
            segment = np.repeat(np.arange(len(part.row)), part.ends - part.begins)[:places]
            start = np.flatnonzero(np.arange(places) + window <= part.ends[segment])
            chosen = start + offset[start]
            edges = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
            low, high = start[edges], start[np.append(edges[1:], len(start)) - 1]
            at, size = chosen[edges], high - low + window
            if not whole:
                return (least[at],)
            stretch = two.of(two.sums(part.words), low, size) ^ mixed(((at - low) << 32 | size).astype(np.uint64))
            of = segment[low]
            return least[at], mixed(stretch), part.row[of], part.first[of] + low - part.begins[of], size

        def batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in reader.parts(batch.column("text").to_pylist()):
                a, *rest = found(part)
                if not rest:
                    yield pa.RecordBatch.from_arrays([signed(a)], names=["a"])
                    continue
                c, row, place, size = rest
                key = batch.column("key").to_numpy(zero_copy_only=False)[row]
                yield pa.RecordBatch.from_arrays(
                    [signed(a), signed(c), batch.column("id").take(pa.array(row)), pa.array(key << 32 | place), pa.array(size.astype(np.int32))],
                    names=["a", "c", "id", "at", "size"])

        return batches

    return per_batch(work)


def windows_of(window: int):
    """The windows of the stretches ``led`` of each text: anchor's hash, window's hash, document and place."""

    def work():
        reader, two = Reader(window), Rolling(0xD6E8FEB86659FD93)

        def batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            led = batch.column("led")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(led.value_lengths()))
            flat = led.flatten()
            a, at, size = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("a", "at", "size"))
            order = np.lexsort((at, row))
            row, a, at, size = row[order], a[order], at[order], size[order]
            key, place = at >> 32, at & 0xFFFFFFFF
            for part in reader.parts(batch.column("text").to_pylist()):
                sums = two.sums(part.words)
                # A stretch lies within the segment of its first word.
                segment_of = {(r, f): s for s, (r, f) in enumerate(zip(part.row.tolist(), part.first.tolist(), strict=True))}
                segment = np.array([segment_of.get((r, p // MOST * MOST), -1) for r, p in zip(row.tolist(), place.tolist(), strict=True)], np.int64)
                mine = np.flatnonzero(segment >= 0)
                counts = size[mine] - window + 1
                each = np.repeat(mine, counts)
                step = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = place[each] + step
                here = part.begins[segment[each]] + start - part.first[segment[each]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[each]), signed(two.of(sums, here, window)), batch.column("id").take(pa.array(row[each])), pa.array(key[each] << 32 | start)],
                    names=["a", "w", "id", "at"])

        return batches

    return per_batch(work)


def without(window: int):
    """Texts without the words of ``spans``: counts, the maximal stretches removed, and the words kept, joined by one space."""

    def work():
        def batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            spans = batch.column("spans")
            lengths = np.asarray(spans.value_lengths().fill_null(0))
            ends = np.cumsum(lengths)
            flat = spans.flatten()
            starts, sizes = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("start", "size"))
            rows = []
            for text, end, n in zip(batch.column("text").to_pylist(), ends.tolist(), lengths.tolist(), strict=True):
                words = text.encode().split()
                if not n:
                    rows.append((len(words), 0, [], b" ".join(words)))
                    continue
                own = slice(end - n, end)
                change = np.bincount(starts[own], minlength=len(words) + 1) - np.bincount(starts[own] + sizes[own], minlength=len(words) + 1)
                keep = np.cumsum(change[:-1]) == 0
                edges = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]))).reshape(-1, 2)
                rows.append((len(words), int((~keep).sum()), [{"start": s, "words": e - s} for s, e in edges.tolist()], b" ".join(compress(words, keep.tolist()))))
            n, removed, repeats, kept = zip(*rows, strict=True)
            shape = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(repeats, shape), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["id", "n_words", "n_removed", "repeats", "kept"])

        return batches

    return per_batch(work)


def repeated_spans(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``(id, at, size)``: stretches of documents all of whose windows also start earlier.

    ``rows`` are ``(id, key, text)``; ``at`` is the place of a word, with the row's key above it. The stretches cover every
    word of every such window. In steps:

    1. Anchors that occur once can't lie in a repeat; the others' rows are kept, texts stay where they are.
    2. Rows of one anchor and one stretch around it are a class, led by the first. The others match it over the whole
       stretch. One row a class is what is compared further.
    3. Classes that share an anchor match in some of their windows or in none: leaders alone are extended window by
       window, and the first of equal windows leads.

    Classes, windows and counts are combined in each task before they are shuffled, so an anchor that a third of all
    documents hold is a few rows a task; nothing is paired within a class.
    """
    kind = rows.schema["id"].dataType.simpleString()
    singles = rows.mapInArrow(anchored(window, anchor, False), "a long")
    repeated = written(singles.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select(F.col("a").alias("h")), "anchors")
    all_seeds = rows.mapInArrow(anchored(window, anchor, True), f"a long, c long, id {kind}, at long, size int")
    seeds = written(may_be_in(all_seeds, F.col("a"), repeated).where("__may").drop("__may"), "seeds")
    drop(repeated)
    classes = written(seeds.groupBy("a", "c").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("lead"), F.first("size").alias("size")), "classes")
    follow = join_groups(seeds, classes.where("n > 1").select("a", "c", "n", "lead"), ["a", "c"], "n", "inner").where(
        F.struct("id", "at") > F.col("lead")).select("id", "at", "size")
    followers = written(follow, "followers")
    drop(seeds)
    several = written(classes.groupBy("a").agg(F.count("*").alias("m")).where("m > 1"), "several")
    leaders = join_groups(classes, several, ["a"], "m", "inner").select("lead.id", F.shiftright("lead.at", 32).alias("key"), F.struct("a", "lead.at", "size").alias("one"))
    by_document = leaders.groupBy("id", "key").agg(F.collect_list("one").alias("led")).withColumnsRenamed({"id": "_id", "key": "_key"})
    led = rows.join(by_document, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("id", "text", "led")
    windows = written(led.mapInArrow(windows_of(window), f"a long, w long, id {kind}, at long"), "windows")
    firsts = written(windows.groupBy("a", "w").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("lead")).where("n > 1"), "firsts")
    later = join_groups(windows, firsts, ["a", "w"], "n", "inner").where(F.struct("id", "at") > F.col("lead"))
    return followers.unionByName(later.select("id", "at", F.lit(window).alias("size")))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, repeats, kept.

    Words are what ASCII white space parts. A window is ``window`` consecutive words of one document; every word is
    removed that lies in a window whose words, in order, also start earlier: in a document of a smaller id, or earlier in
    the same one. ``repeats`` are the maximal stretches removed, as first word and number of words; ``kept`` are the other
    words, joined by one space. Windows are judged on the texts as they are, so copies of a removed copy go too.

    Null and empty texts have no words. Null ids come before all others. Rows that repeat an id and its text are one
    document and give equal rows; rows of one id and different texts are told apart, and ordered, by 31 bits of a hash of
    the text. Texts of fewer words than a window stay whole. Other columns aren't looked at. An empty table gives an
    empty table. Windows are equal if two hashes of 64 bits are.
    """
    if not 1 <= anchor <= window:
        raise ValueError("an anchor has at least one word and at most those of a window")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.shiftrightunsigned(F.xxhash64("text"), 33).alias("key"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    spans = repeated_spans(rows, window, anchor).select(
        F.col("id").alias("_id"), F.shiftright("at", 32).alias("_key"),
        F.struct(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("start"), F.col("size").cast("long").alias("size")).alias("span"))
    by_document = spans.groupBy("_id", "_key").agg(F.collect_set("span").alias("spans"))
    met = rows.join(by_document, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("id", "text", "spans")
    out = met.mapInArrow(without(window), f"id {kind}, n_words long, n_removed long, repeats array<struct<start: long, words: long>>, kept string")
    return out.withColumnRenamed("id", id_col)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM worded WHERE len(ws) >= 20),
windows AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) AS nth FROM places),
removed AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM windows WHERE nth > 1),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM worded),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS k, count(*) AS n FROM words ANTI JOIN removed USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM worded LEFT JOIN kept USING (doc_id)
"""
