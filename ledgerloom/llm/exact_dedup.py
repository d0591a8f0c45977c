"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then a hash of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, join_groups, load, may_be_in
from ledgerloom.scratch import written

#: Characters that the second step hashes.
PREFIX = 128


def measures(text: Column, prefix: int) -> list[Column]:
    """Length and prefix hash of a text."""
    return [F.octet_length(text).alias("size"), F.xxhash64(F.substring(text, 1, prefix)).alias("head")]


def repeated_heads(rows: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """``(size, head, n)``: lengths and prefix hashes that more than one row of ``(id, text)`` has.

    The lengths that occur twice come first, prefixes are looked at only within these. No text moves.
    """
    narrow = written(rows.select(*measures(F.col("text"), prefix)), "heads")
    lengths = written(narrow.groupBy("size").agg(F.count("*").alias("n")).where("n > 1"), "lengths")
    same_length = join_groups(narrow, lengths, ["size"], "n", "left_semi")
    return written(same_length.groupBy("size", "head").agg(F.count("*").alias("n")).where("n > 1"), "repeated")


def duplicate_groups(rows: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """``(size, digest, keep_id, group_size)`` of each text that more than one row of ``(id, text)`` holds.

    Whole texts are read and hashed only where length and prefix are shared. Counts are combined before each shuffle, so
    a group with a third of all rows arrives as one row from each task.
    """
    heads = repeated_heads(rows, prefix)
    measured = rows.select("id", "text", *measures(F.col("text"), prefix))
    open_ = may_be_in(measured, F.xxhash64("size", "head"), heads.select(F.xxhash64("size", "head").alias("h"))).where("__may")
    hashed = open_.select("id", "size", "head", F.sha2("text", 256).alias("digest"))
    each = hashed.groupBy("size", "head", "digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    exact = each.join(heads.select("size", "head"), ["size", "head"], "left_semi")
    return written(exact.where("group_size > 1").select("size", "digest", "keep_id", "group_size"), "groups")


def grouped(rows: DataFrame, prefix: int) -> DataFrame:
    """``(id, size, digest, keep_id, group_size)`` of all rows, the last two null where no other row has the text."""
    groups = duplicate_groups(rows, prefix)
    marked = written(rows.select("id", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("digest")), "marked")
    return written(join_groups(marked, groups, ["size", "digest"], "group_size"), "grouped")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty, and all empty texts are one group. The largest id of a
    group stays. A null id never wins against another; a group of null ids only keeps one row. Of rows that repeat id
    and text, one is kept. Other columns are not looked at. An empty table gives an empty table.
    """
    found = grouped(id_and_text(docs, id_col, text_col), prefix)
    wins = F.col("group_size").isNotNull() & F.col("keep_id").eqNullSafe(F.col("id"))
    winners = found.where(wins).withColumn("kept", F.row_number().over(Window.partitionBy("digest", "id").orderBy("size")) == 1)
    others = found.where(~wins).withColumn("kept", F.col("group_size").isNull())
    keep_id = F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("id"))
    return winners.unionByName(others).select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "kept", F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps.

    Only rows to be dropped, and those that repeat id and text, move with their texts. Of the latter the one whose other
    columns have the least hash stays.
    """
    rows = id_and_text(docs, id_col, text_col)
    groups = duplicate_groups(rows, prefix).select("size", "digest", "keep_id", "group_size")
    heads = groups.select(F.xxhash64("size", "digest").alias("h"))
    marked = rows.select("id", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("digest"))
    copies = may_be_in(marked, F.xxhash64("size", "digest"), heads).where("__may").drop("__may")
    each = join_groups(copies, groups, ["size", "digest"], "group_size").where("group_size is not null").groupBy("digest", "id").agg(
        F.count("*").alias("n"), F.first("keep_id").alias("keep_id"))
    loses = ~F.col("keep_id").eqNullSafe(F.col("id"))
    suspects = written(each.where(loses | (F.col("n") > 1)).select(F.col("digest").alias("__digest"), F.col("id").alias("__id"), loses.alias("__loses")), "suspects")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    judged = may_be_in(docs.withColumn("__own", digest), F.xxhash64("__own", F.col(id_col)), suspects.select(F.xxhash64("__digest", "__id").alias("h")))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest"))
    met = judged.where("__may").join(suspects, same, "left").where("__loses is null or not __loses")
    alone = met.where("__loses is null")
    first = Window.partitionBy("__own", id_col).orderBy(F.xxhash64(*docs.columns))
    repeated = met.where("__loses is not null").withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
    return judged.where("not __may").select(*docs.columns).unionByName(alone.select(*docs.columns)).unionByName(repeated.select(*docs.columns))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
