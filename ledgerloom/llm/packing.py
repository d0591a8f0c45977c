"""Packing of documents into sequences of one length, balanced by the cost of attention."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, load, small_batches
from ledgerloom.llm.token_counts import model_path

MODEL = "byte_bpe_50k.json"
END = 1
LENGTH = 2048
#: Remainders packed together; a task holds no more of them at once.
POOL = 4096
#: Cost of a token by itself, and of a pair of tokens of one document that attend to each other.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merging(spec: dict):
    """The vocabulary's merges as an ``Encoding``; None if the file is of another kind."""
    import tiktoken

    vocabulary, before = spec["model"].get("vocab"), spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or spec.get("normalizer") or (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) != ("ByteLevel", False, True):
        return None
    # Bytes that print stand for themselves in the file, the others in turn for the characters from 256 on.
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printing)))}
    special = {token["content"] for token in spec["added_tokens"]}
    ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in vocabulary.items() if token not in special}
    pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in spec["model"]["merges"]]
    if any(vocabulary[a + b] != 256 + i for i, (a, b) in enumerate(pairs)):
        return None  # an id isn't the rank of its merge
    return tiktoken.Encoding("merges", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@cache
def encoder(model: str) -> Callable[[str], bytes]:
    """The ids that ``tokenizers`` gives a text, as little-endian unsigned 32-bit numbers.

    The file's merges are applied by the faster of two libraries; texts that hold special strings, and files of another
    kind, are left to ``tokenizers``. Both give the same ids.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(model)
    whole = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    with open(model, encoding="utf-8") as file:
        spec = json.load(file)
    merges = merging(spec)
    if not merges:
        return whole
    special = [token["content"] for token in spec["added_tokens"]]

    def encode(text: str) -> bytes:
        if any(token in text for token in special):
            return whole(text)
        return np.array(merges.encode_ordinary(text), "<u4").tobytes()

    return encode


def capacities(total: int, length: int) -> list[int]:
    """Sequences that ``total`` tokens fill to the last place: full ones, and powers of two for what is left."""
    rest = total % length
    return [length] * (total // length) + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def balance(lengths: list[int], length: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of each piece of documents of the given lengths.

    Documents are taken in descending order of length (ties: as given). Each goes to the sequence of the lowest cost so
    far that has room for it; where none has, it fills the one with the most room and the rest goes on. Sequences have
    room for exactly all tokens, so none is padded but where its length isn't a power of two or ``length``.
    """
    room = np.array(capacities(sum(lengths), length), dtype=np.int64)
    used, cost = np.zeros_like(room), np.zeros(len(room))
    out = []
    for document in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, left = 0, lengths[document]
        while left:
            fits = np.flatnonzero(room >= left)
            sequence = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            taken = int(min(left, room[sequence]))
            out.append((document, start, taken, sequence, int(used[sequence])))
            room[sequence] -= taken
            used[sequence] += taken
            cost[sequence] += linear * taken + quadratic * taken * taken
            start, left = start + taken, left - taken
    return out


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, model: str | None = None, pool: int = POOL, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if ``with_ids``).

    A document is the library's ids of its text (null: empty) and the end id, so each has one token at least. What of it
    fills whole sequences is cut off first; the remainders are packed in pools of ``pool`` documents with ``balance``,
    whose sequences hold ``length`` tokens or, for a pool's last tokens, a power of two. Nothing is padded or shuffled:
    a task packs the documents it reads, and its number is the upper part of its sequences' ids, so that a task that
    runs again gives the same rows. Repeated rows are packed each for itself, in a sequence or in several; ids may be
    null; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    model = model or model_path(MODEL)

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(model), np.asarray([END], "<u4").tobytes()
        first, sequences = TaskContext.get().partitionId() << 36, 0
        waiting: list[tuple[object, bytes, int, int]] = []  # id, remaining ids, where they start, tokens in all
        rows: list[tuple] = []

        def emit(doc, ids: bytes, start: int, total: int, sequence: int, offset: int) -> None:
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, first + sequence, offset, *([ids] if with_ids else [])))

        def settle() -> None:
            nonlocal sequences
            plan = balance([len(ids) // 4 for _, ids, _, _ in waiting], length)
            for document, start, taken, sequence, offset in plan:
                doc, ids, cut, total = waiting[document]
                emit(doc, ids[4 * start : 4 * (start + taken)], cut + start, total, sequences + sequence, offset)
            sequences += max((row[3] for row in plan), default=-1) + 1
            waiting.clear()

        def batch_of_rows() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], id_type)] + [pa.array(c, pa.int64()) for c in columns[1:7]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(ids, "<u4").astype(np.int64) for ids in columns[7]], pa.list_(pa.int64())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, NAMES[: len(arrays)])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text) + end
                total = len(ids) // 4
                whole = total - total % length
                for start in range(0, whole, length):
                    emit(doc, ids[4 * start : 4 * (start + length)], start, total, sequences, 0)
                    sequences += 1
                if whole < total:
                    waiting.append((doc, ids[4 * whole :], whole, total))
                if len(waiting) == pool:
                    settle()
            if rows:
                yield batch_of_rows()
        settle()
        if rows:
            yield batch_of_rows()

    rows = id_and_text(docs, id_col, text_col)
    schema = f"id {dict(rows.dtypes)['id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    pieces = rows.mapInArrow(packing, schema + ", ids array<long>" * with_ids)
    return pieces.withColumnRenamed("id", id_col)


NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def padding(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row: sequences, tokens, padded places, and the largest cost over the mean among full sequences."""
    each = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("used"), F.sum(F.col("length") * LINEAR + F.col("length") ** 2 * QUADRATIC).alias("cost"))
    two = F.expr("bit_count(used) = 1")
    return each.agg(
        F.count("*").alias("sequences"), F.sum("used").alias("tokens"),
        F.sum(F.when(two, 0).otherwise(length - F.col("used"))).alias("padded"),
        (F.max("cost") / F.avg("cost")).alias("cost_over_mean"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(load(spark, sf_dir, "documents"))
