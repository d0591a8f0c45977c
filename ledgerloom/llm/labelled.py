"""Labelled documents that classifiers learn from."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, per_batch, remainder
from ledgerloom.llm.shingles import Shingler
from ledgerloom.scratch import written

#: At most so many labelled documents are learnt from; where more are, a share chosen by a hash of their id.
FIT_ROWS = 20_000
#: Documents whose id has this remainder are never learnt from; the next one calibrates.
FOLDS, HELD_OUT, CALIBRATES = 5, 0, 1


def held_out(id_col: str | Column) -> Column:
    return F.coalesce(remainder(id_col, FOLDS) == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(text, target, calibrates)`` of labelled documents outside the held-out fold, written once.

    Labels other than 0 and 1 and ids without a document are passed over; the largest of several labels of an id
    counts. Copies would teach a text's own words many times over: of documents of one label whose least shingle hash
    is the same, one is taken.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(target).cast("int").alias("target"))
    share = min(1.0, 0.95 * fit_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # At most fit_rows rows of two numbers: their size is bounded whatever the corpus.
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "id").select(
        "text", "target", (remainder("id", FOLDS) == CALIBRATES).alias("calibrates"))

    def marking():
        shingler = Shingler()

        def one(batch: pa.RecordBatch):
            least = [int(s[0]) >> 1 if len(s) else -1 for s in (shingler(t)[0] for t in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], [*batch.schema.names, "least"])

        return one

    marked = texts.mapInArrow(per_batch(marking), "text string, target int, calibrates boolean, least long")
    one = marked.groupBy("least", "target").agg(F.min(F.struct("text", "calibrates")).alias("first"))
    return written(one.select("first.text", "target", "first.calibrates"), "labelled")
