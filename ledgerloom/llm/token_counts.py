"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, load, per_batch, small_batches
from ledgerloom.llm.hash_tables import Shards, Store, shard_of, shards_for

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: No piece has a space after another character, and none a line feed: both end a pre-token.
PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")
#: How far a worker's set of pre-tokens may grow before it starts anew.
MOST_PRE_TOKENS = 500_000
#: Bytes of text whose distinct pre-tokens one shard holds.
SHARD_BYTES = 32 << 20


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens(text: str) -> list[str]:
    return PRE_TOKEN.findall(" " + text.replace(SPACE, " ")) if text else []


@cache
def piece_counter(model: str) -> Callable[[str], int]:
    """Pieces of a pre-token within a text, as the library counts them."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    # The library puts a space before any text. A line feed there takes it up, at the cost of the same pieces each time.
    inner = len(library.encode("\n"))

    def count(pre_token: str) -> int:
        if pre_token in (" ", "\n"):
            return 1
        if pre_token[0] == " ":
            return len(library.encode(pre_token[1:]))
        return len(library.encode("\n" + pre_token)) - inner

    return count


def hashes_of(pre_tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, pre_tokens), np.uint64, len(pre_tokens))


def count_pieces(rows: DataFrame, model: str, shards: int) -> Store:
    """The pieces of each distinct pre-token of ``rows``' texts, counted once, as a table by hash in the shared folder."""
    store = Store(rows.sparkSession, "token-counts")

    def finding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's distinct pre-tokens, those of a shard in one row, a line feed (which none holds) after each."""
        found: set[str] = set()

        def out() -> pa.RecordBatch:
            found.discard("\n")
            listed = list(found)
            shard = shard_of(hashes_of(listed), shards)
            order = np.argsort(shard, kind="stable")
            numbers, starts = np.unique(shard[order], return_index=True)
            joined = ["".join(listed[i] + "\n" for i in part.tolist()) for part in np.split(order, starts[1:])] if len(numbers) else []
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(joined, pa.string())], ["shard", "pre_tokens"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(pre_tokens(text))
            if len(found) >= MOST_PRE_TOKENS:
                yield out()
        yield out()

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, shard, found = piece_counter(model), 0, set()
        for batch in batches:
            for number, joined in zip(batch.column("shard").to_pylist(), batch.column("pre_tokens").to_pylist(), strict=True):
                shard = number
                found.update(joined.split("\n")[:-1])
        listed = list(found)
        keys, pieces = hashes_of(listed), np.fromiter(map(count, listed), np.int64, len(listed))
        order = np.argsort(keys)
        keys, pieces = keys[order], pieces[order]
        kept = keys >> np.uint64(16)  # what the table keeps of a key
        first = np.concatenate([[True], kept[1:] != kept[:-1]])
        pieces[first & np.concatenate([kept[1:] == kept[:-1], [False]])] = 0  # of several pre-tokens: none counts here
        yield pa.RecordBatch.from_arrays([pa.array([store.put("pieces", shard, keys[first], pieces[first])], pa.int64())], ["n"])

    each = rows.select("text").mapInArrow(finding, "shard int, pre_tokens string")
    store.seal(shards, each.groupBy("shard").applyInArrow(counting, "n long").agg(F.sum("n")).first()[0] or 0)
    return store


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, model: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens; ids may be null or repeat, other columns are not looked at.
    The pieces of each distinct pre-token are counted once for the whole corpus and stored as sorted hash arrays in the
    shared folder; each task joins its documents' pre-token frequencies to these. Only distinct pre-tokens are shuffled,
    combined in each task, so a hot source or a hot word costs no more than another. ``model`` is a path that all workers
    can read. Pre-tokens whose hashes are the same, are counted where they occur.
    """
    small_batches(docs.sparkSession)
    model = model or model_path()
    rows = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    shards = shards_for(rows, shard_bytes)
    store = count_pieces(rows, model, shards)

    def joining():
        count, table, known = piece_counter(model), Shards(store, "pieces", shards, (0,)), {"\n": 1}

        def one(batch: pa.RecordBatch):
            found = [pre_tokens(text) for text in batch.column("text").to_pylist()]
            if len(known) >= MOST_PRE_TOKENS:
                known.clear()
                known["\n"] = 1
            wanted = list(set().union(*found).difference(known))
            keys = hashes_of(wanted)
            known.update((w, n or count(w)) for w, n in zip(wanted, table(keys, keys)[:, 0].tolist(), strict=True))
            counts = [sum(map(known.__getitem__, own)) for own in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

        return one

    counted = rows.mapInArrow(per_batch(joining), f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"))
