"""Explanations from an outside generator: few calls at once, a deadline, another try, and a cache that is written back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.explain import PROMPT_VERSION, clean_generated, explained, review_triggers
from ledgerloom.scratch import written

CACHE = T.StructType([T.StructField(n, T.StringType() if n != "match_id" else T.LongType()) for n in ("match_id", "input_hash", "prompt_version", "explanation", "provider", "model")])
#: Who wrote a text that no generator did.
LOCAL = ("local", "deterministic-v1")


def asked(rows: DataFrame, generator: Callable[[str], str], seconds: float = 10.0, attempts: int = 2, at_once: int = 8) -> DataFrame:
    """``(match_id, text)`` by ``generator`` from each row's JSON ``input``; null where it failed or took longer than ``seconds``.

    A task has ``at_once`` calls under way at most. A call that fails is tried again, ``attempts`` times in all within
    the same deadline. No failure of the generator fails the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import queue
        import threading
        import time

        def one(text: str, answer: queue.Queue) -> None:
            for _ in range(attempts):
                try:
                    answer.put(generator(text))
                    return
                except Exception:  # any failure of one call stays its own
                    continue
            answer.put(None)

        for batch in batches:
            texts = []
            for first in range(0, len(batch), at_once):
                answers: list[queue.Queue] = [queue.Queue(1) for _ in batch.input[first : first + at_once]]
                for text, answer in zip(batch.input[first : first + at_once], answers, strict=True):
                    # A call that runs on ends with its worker and doesn't keep it.
                    threading.Thread(target=one, args=(text, answer), daemon=True).start()
                end = time.monotonic() + seconds
                for answer in answers:
                    try:
                        texts.append(answer.get(timeout=max(0.0, end - time.monotonic())))
                    except queue.Empty:
                        texts.append(None)
            yield pd.DataFrame({"match_id": batch.match_id, "text": pd.Series(texts, dtype="object")})

    return rows.select("match_id", "input").mapInPandas(run, "match_id long, text string")


def explain_on_demand(
    candidates: DataFrame, cache: str, generator: Callable[[str], str] | None = None, provider: str = "remote", model: str = "unknown",
    seconds: float = 10.0, attempts: int = 2, at_once: int = 8) -> DataFrame:
    """``(match_id, explanation, provider, model, cached)`` of open candidates of documents under review.

    Texts kept in the folder ``cache`` for the same match, input and version are taken from there. The others are asked
    for; where the generator fails, is late, or gives a text of fewer than 20 or more than 360 characters, and where there
    is none, the local text stands. What is new is kept. Candidates have the columns of ``review_triggers``, and one row
    for each match.
    """
    spark = candidates.sparkSession
    kept = read_cache(spark, cache)
    rows = written(explained(review_triggers(candidates), kept), "explained")
    missing = rows.where("not cached")
    if generator is None:
        texts = missing.select("match_id", F.lit(None).cast("string").alias("text"))
    else:
        body = F.to_json(F.struct(
            "confidence", "decision_confidence", "position", "candidate_count", "top_gap", "evidence_coverage", "signals", "contradictions", F.col("triggers").alias("review_triggers")))
        texts = asked(missing.withColumn("input", body), generator, seconds, attempts, at_once)
    # The generator may answer otherwise next time: what it says is written before it is used twice.
    answers = written(texts.select("match_id", clean_generated(F.col("text")).alias("text")), "answers")
    by = lambda outside, local: F.when(F.col("text").isNotNull(), outside).otherwise(local)
    new = missing.join(answers, "match_id").select(
        "match_id", "input_hash", F.lit(PROMPT_VERSION).alias("prompt_version"), F.coalesce("text", "explanation").alias("explanation"), by(provider, LOCAL[0]).alias("provider"), by(model, LOCAL[1]).alias("model"))
    new = written(new, "new-explanations")
    new.write.mode("append").parquet(cache)
    old = rows.where("cached").join(kept.where(F.col("prompt_version") == PROMPT_VERSION).select("match_id", "input_hash", "provider", "model"), ["match_id", "input_hash"])
    columns = ["match_id", "explanation", "provider", "model"]
    return new.select(*columns, F.lit(False).alias("cached")).unionByName(written(old.select(*columns, F.lit(True).alias("cached")), "kept"))


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """Texts kept, one for each match, input and version."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache).dropDuplicates(["match_id", "input_hash", "prompt_version"])
