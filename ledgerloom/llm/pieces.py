"""Sampled segmentations: forward filtering and backward sampling over the lattice of pieces, and lossless decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, load, per_batch, small_batches
from ledgerloom.llm.shingles import mixed
from ledgerloom.llm.token_counts import PRE_TOKEN, SPACE, model_path

#: The power that piece probabilities are raised to; lower values sample more varied segmentations.
ALPHA = 0.3
#: The vocabulary's ranks stand for frequencies: a piece's probability falls as one over its rank and this many more.
SHIFT = 10
#: Log probability of one byte of a character that no piece spells.
BYTE = -15.0
#: Edges that stand for a character's bytes have this bit set, and the character's code.
SPELT = 1 << 24
#: Characters of runs of one length whose lattices are filtered at once.
BLOCK = 1 << 17
#: Characters of a longer run's lattice that are held at once.
STRETCH = 1 << 12
#: Characters of the texts that are encoded together, unless one text has more.
TOGETHER = 4_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = np.uint64(20)


class Surfaces:
    """Piece ids by the hash of a piece's characters, for many strings at once: two tables, the second for what collides in the first."""

    def __init__(self, surfaces: dict[str, int]):
        for seed in range(1, 1000):
            self.seed = np.uint64(seed)
            self.hash = np.zeros(max(surfaces.values()) + 2, np.uint64)
            self.first = np.full(1 << int(TABLE_BITS), -1, np.int32)
            self.second = np.full(1 << int(TABLE_BITS), -1, np.int32)
            if all(self.add(surface, n) for surface, n in surfaces.items()):
                return
        raise ValueError("no seed tells the pieces apart")

    def grow(self, hashes: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The hashes of strings that are one character longer."""
        return mixed(hashes * np.uint64(31) + characters + self.seed)

    def add(self, surface: str, n: int) -> bool:
        h = np.zeros(1, np.uint64)
        for character in surface:
            h = self.grow(h, np.array([ord(character)], np.uint64))
        self.hash[n] = h[0]
        for table, at in ((self.first, int(h[0] >> (np.uint64(64) - TABLE_BITS))), (self.second, int(h[0]) & ((1 << int(TABLE_BITS)) - 1))):
            if table[at] < 0:
                table[at] = n
                return True
        return False

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Ids, -1 where no piece has the hash."""
        n = self.first[hashes >> (np.uint64(64) - TABLE_BITS)]
        found = self.hash[n] == hashes  # id -1 has the hash 0, which no string has
        other = self.second[hashes & np.uint64((1 << int(TABLE_BITS)) - 1)]
        return np.where(found, n, np.where(self.hash[other] == hashes, other, -1))


def utf8_bytes(code: np.ndarray) -> np.ndarray:
    """How many bytes characters have."""
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


def utf8_byte(code: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
    """Byte number ``at`` of characters that have more than ``at`` bytes."""
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    part = code >> (6 * (size - 1 - at))
    return np.where(size == 1, code, (lead | part) if at == 0 else 0x80 | (part & 0x3F))


class Pieces:
    """Encoding and decoding with a model's pieces."""

    def __init__(self, model: str, alpha: float = ALPHA):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        count = library.get_piece_size()
        self.bytes = [b""] * count
        self.byte_id = np.zeros(256, np.int64)
        self.weight = np.full(count + 1, -np.inf)  # the last is that of id -1
        surfaces = {}
        for n in range(count):
            piece = library.id_to_piece(n)
            if library.is_byte(n):
                self.byte_id[int(piece[3:5], 16)] = n
                self.bytes[n] = bytes([int(piece[3:5], 16)])
            elif not (library.is_control(n) or library.is_unknown(n) or library.is_unused(n)):
                surface = piece.replace(SPACE, " ")
                self.bytes[n] = surface.encode()
                surfaces[surface] = n
                self.weight[n] = -alpha * np.log(n + SHIFT)
        self.longest = max(map(len, surfaces))
        self.alpha = alpha
        self.surfaces = Surfaces(surfaces)

    def ending(self, codes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and weights of the pieces that end at places ``low + 1`` to ``high``: for each run, place and length less one."""
        runs, length = codes.shape
        width = min(length, self.longest)
        first = max(0, low + 1 - width)
        own = codes[:, first:high].astype(np.uint64)
        ids = np.full((runs, high - low, width), -1, np.int32)
        h = np.zeros(own.shape, np.uint64)
        for more in range(min(width, high - first)):
            h = self.surfaces.grow(h[:, : high - first - more], own[:, more:])
            before = max(0, low - first - more)  # starts whose piece of this length ends at low or earlier
            ids[:, first + before + more - low :, more] = self.surfaces(h[:, before:])
        weight = self.weight[ids]
        spelt, characters = ids[:, :, 0] < 0, codes[:, low:high]
        ids[:, :, 0] = np.where(spelt, characters | SPELT, ids[:, :, 0])
        weight[:, :, 0] = np.where(spelt, self.alpha * BYTE * utf8_bytes(characters), weight[:, :, 0])
        return ids, weight

    def filtered(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward filtering of runs of one length, a row of character codes each.

        Returns, for each run, place less one and length of the piece that ends there, less one: the share of what arrives
        there that pieces up to this length bring, and the piece's id. Shares past the last length are over 1.
        """
        runs, length = codes.shape
        ids, weight = self.ending(codes, 0, length)
        width = ids.shape[2]
        total = np.zeros((runs, length + 1))
        upto = np.full((runs, length, width), 2.0)
        for end in range(1, length + 1):
            sizes = min(end, width)
            score = total[:, end - sizes : end][:, ::-1] + weight[:, end - 1, :sizes]
            top = score.max(1, keepdims=True)
            share = np.exp(score - top).cumsum(1)
            upto[:, end - 1, :sizes] = share / share[:, -1:]
            total[:, end] = top[:, 0] + np.log(share[:, -1])
        return upto, ids

    def totals(self, codes: np.ndarray) -> np.ndarray:
        """Forward filtering of one long run, stretch by stretch: what arrives at each place, after as many places that nothing reaches as the longest piece has characters."""
        length, width = codes.shape[1], min(codes.shape[1], self.longest)
        total = np.full(width + length + 1, -np.inf)
        total[width] = 0.0
        for low in range(0, length, STRETCH):
            weight = self.ending(codes, low, min(low + STRETCH, length))[1][0]
            for end, own in enumerate(weight, low + 1):
                score = total[end : end + width][::-1] + own
                top = score.max()
                total[width + end] = top + np.log(np.exp(score - top).sum())
        return total

    def long_run(self, occurrences: np.ndarray, codes: np.ndarray, key: np.ndarray, emitted: np.ndarray) -> list:
        """What ``sampled`` gives for the occurrences of one long run; the shares of one stretch are held at a time."""
        total = self.totals(codes)
        length, width = codes.shape[1], min(codes.shape[1], self.longest)
        windows = np.lib.stride_tricks.sliding_window_view(total, width)
        state = (occurrences, np.zeros(len(occurrences), np.int64), np.full(len(occurrences), length), np.zeros(len(occurrences), np.uint64))
        out = []
        for low in reversed(range(0, length, STRETCH)):
            high = min(low + STRETCH, length)
            ids, weight = self.ending(codes, low, high)
            score = windows[low + 1 : high + 1, ::-1] + weight[0]
            share = np.exp(score - score.max(1, keepdims=True)).cumsum(1)
            records, state = self.sampled(state, low, (share / share[:, -1:])[None], ids, key, emitted)
            out += records
        return out

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of a sampled segmentation of each text; the same text and key give the same. Empty texts have none.

        The lattice falls apart at the runs of ``PRE_TOKEN``: each distinct run is filtered once, each occurrence samples
        from the end, with draws hashed from the key, the occurrence's number and the step.
        """
        number: dict[str, int] = {}
        found = [[number.setdefault(run, len(number)) for run in PRE_TOKEN.findall(" " + text)] if text else [] for text in texts]
        count = np.array([len(f) for f in found], np.int64)
        occurrence = np.concatenate([np.asarray(f, np.int64) for f in found]) if found else np.zeros(0, np.int64)
        first = np.cumsum(count) - count
        key = np.repeat(np.asarray(keys, np.uint64), count)
        key = mixed(key + (np.arange(len(occurrence)) - np.repeat(first, count)).astype(np.uint64) * GOLDEN)
        runs = list(number)
        length_of = np.array([len(r) for r in runs], np.int64)
        emitted = np.zeros(len(occurrence), np.int64)
        records = []
        by_length = np.argsort(length_of, kind="stable")
        row_of = np.empty(len(runs), np.int64)
        sizes, starts = np.unique(length_of[by_length], return_index=True)
        in_order = np.argsort(length_of[occurrence], kind="stable") if len(runs) else occurrence
        edges = np.searchsorted(length_of[occurrence][in_order], sizes) if len(runs) else []
        for length, start, end, low, high in zip(sizes, starts, [*starts[1:], len(runs)], edges, [*edges[1:], len(in_order)], strict=True) if len(runs) else ():
            own = by_length[start:end]
            own_occurrences = in_order[low:high]
            row_of[own] = np.arange(len(own))
            if length > STRETCH:
                for i in own:
                    codes = np.frombuffer(runs[i].encode("utf-32-le"), "<u4").astype(np.int64)[None]
                    records += self.long_run(own_occurrences[occurrence[own_occurrences] == i], codes, key, emitted)
                continue
            block = BLOCK // int(length)
            row = row_of[occurrence[own_occurrences]]
            for begin in range(0, len(own), block):
                part = own[begin : begin + block]
                raw = "".join([runs[i] for i in part]).encode("utf-32-le")
                upto, ids = self.filtered(np.frombuffer(raw, "<u4").astype(np.int64).reshape(len(part), length))
                here = np.flatnonzero((row >= begin) & (row < begin + len(part))) if len(own) > block else slice(None)
                met = own_occurrences[here]
                state = (met, row[here] - begin, np.full(len(met), int(length)), np.zeros(len(met), np.uint64))
                records += self.sampled(state, 0, upto, ids, key, emitted)[0]
        return self.assembled(records, emitted, count)

    def sampled(self, state, low: int, upto, ids, key, emitted) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], tuple]:
        """Backward sampling of occurrences, down to place ``low``, which shares and ids begin after.

        ``state`` is ``(occurrence, row, place, steps made)``. Returns ``(occurrence, id, ids emitted before it from the
        end)`` of each step, and the state of the occurrences at ``low``.
        """
        occurrence, row, place, step = state
        out, there = [], []
        while len(occurrence):
            step = step + np.uint64(1)
            draw = (mixed(key[occurrence] + step) >> np.uint64(11)).astype(np.float64) / 2.0**53
            size = (upto[row, place - low - 1] <= draw[:, None]).sum(1)
            n = ids[row, place - low - 1, size].astype(np.int64)
            out.append((occurrence, n, emitted[occurrence]))
            emitted[occurrence] += np.where(n & SPELT, utf8_bytes(n & (SPELT - 1)), 1)
            place = place - size - 1
            on = place > low
            if low and not on.all():
                there.append((occurrence[~on], row[~on], place[~on], step[~on]))
            occurrence, row, place, step = occurrence[on], row[on], place[on], step[on]
        return out, tuple(map(np.concatenate, zip(*there, strict=True))) if there else state

    def assembled(self, records, emitted: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
        """The sampled ids in the order of the texts, one array for each text."""
        end = np.cumsum(emitted)
        out = np.zeros(int(end[-1]) if len(end) else 0, np.int32)
        for occurrence, n, before in [tuple(map(np.concatenate, zip(*records, strict=True)))] if records else ():
            spelt = (n & SPELT) > 0
            plain = ~spelt
            out[end[occurrence[plain]] - before[plain] - 1] = n[plain]
            code = n[spelt] & (SPELT - 1)
            size = utf8_bytes(code)
            first = end[occurrence[spelt]] - before[spelt] - size
            for at in range(4 if len(code) else 0):
                more = size > at
                out[first[more] + at] = self.byte_id[utf8_byte(code[more], size[more], at)]
        upto = np.concatenate([[0], end])[np.cumsum(count)]
        return np.split(out, upto[:-1]) if len(count) else []

    def decode(self, ids: np.ndarray) -> str:
        """The text that ``encode`` was given, whatever it sampled."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))[1:].decode()


def row_key(row_id: object, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(row_id), seed)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, alpha: float = ALPHA, model: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, pieces (array of ids), n_pieces, lossless (they decode to the text again).

    Segmentations are sampled with the pieces' probabilities to the power of ``alpha``, with draws seeded by the row's
    id and ``seed``: they don't depend on partitions or reruns, and rows that repeat id and text repeat the sample. Null
    counts as empty, without pieces; null ids share one seed. Characters without a piece, and the space sign itself,
    become byte pieces. Other columns are not looked at. Nothing is shuffled; a worker filters the distinct runs
    of a bounded stretch of texts at a time.
    """
    small_batches(docs.sparkSession)
    model = model or model_path()

    def encoding():
        pieces = Pieces(model, alpha)

        def one(batch: pa.RecordBatch):
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            filled = np.cumsum([len(t) for t in texts]) // TOGETHER
            edges = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(texts)]
            for first, end in zip(edges, edges[1:], strict=False):
                part, own = texts[first:end], ids.slice(first, end - first)
                found = pieces.encode(part, [row_key(i, seed) for i in own.to_pylist()])
                ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))
                same = [pieces.decode(f) == t for f, t in zip(found, part, strict=True)]
                yield pa.RecordBatch.from_arrays([own, lists, pa.array(same)], ["id", "pieces", "lossless"])

        return one

    rows = id_and_text(docs, id_col, text_col)
    out = rows.mapInArrow(per_batch(encoding), f"id {dict(rows.dtypes)['id']}, pieces array<int>, lossless boolean")
    return out.select(F.col("id").alias(id_col), "pieces", F.size("pieces").cast("long").alias("n_pieces"), "lossless")


def decoded(rows: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", model: str | None = None) -> DataFrame:
    """One row per row of ``rows``: id, text. Null pieces decode to null, an empty array to an empty text."""
    small_batches(rows.sparkSession)
    model = model or model_path()

    def decoding():
        pieces = Pieces(model)

        def one(batch: pa.RecordBatch):
            texts = [None if p is None else pieces.decode(np.asarray(p, np.int32)) for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

        return one

    own = rows.select(F.col(id_col).alias("id"), F.col(pieces_col).alias("pieces"))
    return own.mapInArrow(per_batch(decoding), f"id {dict(own.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(load(spark, sf_dir, "documents"))
