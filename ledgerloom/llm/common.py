"""What the operators on documents share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; Spark's own bound on a batch's bytes holds beside it.
BATCH_ROWS = 1000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers hold."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``id`` and ``text`` only, null texts as empty: other columns cannot clash."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(column.cast("string").cast("binary")) % modulus


def may_be_in(rows: DataFrame, key: Column, wanted: DataFrame, most_slots: int = 1 << 20) -> DataFrame:
    """``rows`` with a boolean ``__may``: false where the hash ``key`` surely isn't among those of ``wanted``'s column ``h``.

    The texts need no shuffle: what is broadcast is a table of 64-bit masks, of one slot for eight hashes up to
    ``most_slots``. The more are wanted beyond that, the more others pass; an exact join follows.
    """
    slots = min(most_slots, 1 << max(10, (wanted.count() // 8).bit_length()))
    slot = lambda h: F.pmod(F.shiftright(h, 6), F.lit(slots))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    masks = wanted.groupBy(slot(F.col("h")).alias("__slot")).agg(F.bit_or(bit(F.col("h"))).alias("__mask"))
    met = rows.withColumn("__h", key).withColumn("__slot", slot(F.col("__h"))).join(F.broadcast(masks), "__slot", "left")
    return met.withColumn("__may", F.coalesce(F.col("__mask").bitwiseAND(bit(F.col("__h"))) != 0, F.lit(False))).select(*rows.columns, "__may")


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, how: str = "left", share: int = 1000) -> DataFrame:
    """``rows`` joined to ``groups``, one row a group, without a key that takes one task long.

    Groups of more than one row in ``share`` of all are fewer than ``share``: they are broadcast, the others shuffled.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.broadcast(groups.where(F.col(size) * share > total))
    others = rows.join(large, on, "left_anti").join(groups.where(F.col(size) * share <= total), on, how)
    columns = others.columns
    return rows.join(large, on, "inner" if how == "left" else how).select(*columns).unionByName(others)


def per_batch(work: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]) -> Callable:
    """Turn a factory of batch functions into what ``mapInArrow`` takes; the factory runs once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = work()
        for batch in batches:
            if batch.num_rows:
                yield from one(batch)

    return run


class Bounded(dict):
    """A dict that computes what it lacks and starts anew when it holds ``most`` keys."""

    def __init__(self, compute: Callable, most: int = 300_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= 64:  # long keys hardly come again
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
