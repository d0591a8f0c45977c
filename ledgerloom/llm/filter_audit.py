"""How five filters interact: which documents each removes in every order of them, by part of the corpus."""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import join_groups, load
from ledgerloom.scratch import written

FILTERS = "ABCDE"
MASKS = range(1 << len(FILTERS))


def word_totals(rows: DataFrame) -> DataFrame:
    """``(id, h, words, distinct_words)`` of each ``(id, h)`` of ``(id, h, text)`` that has words; h is a hash of the text.

    Documents are dealt once, by id and text, and rows that repeat both are made one in each task before. Their words are
    exploded and aggregated where they then are: no words are shuffled.
    """
    one = rows.groupBy("id", "h").agg(F.first("text").alias("text"))
    words = one.select("id", "h", F.explode(F.split("text", "[\\x20\\x09-\\x0D]+")).alias("word")).where("word <> ''")
    each = words.groupBy("id", "h", "word").agg(F.count("*").alias("n"))
    return each.groupBy("id", "h").agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(id, part, times, mask)``: for each id, text and part the number of its rows and the filters it fails, A as 1 to E as 16.

    Null texts and parts count as empty. E looks for an equal text at a smaller id; null ids are not smaller than others
    and have no smaller ones, rows that repeat an id and its text don't fail E by one another.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    ).withColumn("h", F.xxhash64("text"))
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    flags = rows.select(
        "id", "h", "part", (100 * capitals > 2 * F.length("text")).alias("c"), F.col("text").rlike("[#$%&*|]").alias("d"), F.unhex(F.sha2("text", 256)).alias("digest"))
    same = written(flags.groupBy("id", "h", "part").agg(
        F.count("*").alias("times"), *[F.first(x).alias(x) for x in ("c", "d", "digest")]), "audit-flags")
    firsts = written(same.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "audit-firsts")
    known = join_groups(same, firsts, ["digest"], "n").select("id", "h", "part", "times", "c", "d", F.coalesce(F.col("first") < F.col("id"), F.lit(False)).alias("e"))
    counted = word_totals(rows.select("id", "h", "text")).select(F.col("id").alias("_id"), F.col("h").alias("_h"), "words", "distinct_words")
    met = known.join(counted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    words, distinct = (F.coalesce(x, F.lit(0)) for x in ("words", "distinct_words"))
    fails = [words < 200, 100 * distinct < 50 * words, F.col("c"), F.col("d"), F.col("e")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return met.select("id", "part", "times", mask.alias("mask"))


def over_masks(kind: str, condition, weight=lambda mask: 1) -> Column:
    """The sum of the counts of one kind over the masks that ``condition``, of a literal mask, holds for."""
    return sum((F.when(condition(F.lit(m)), F.col(f"{kind}{m}") * weight(m)).otherwise(0) for m in MASKS), F.lit(0).cast("long")).cast("long")


def interaction_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What each step of each of the 120 orders of five filters keeps and removes, for every part of ``docs``.

    Rows are ``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``. The
    filters fail A: under 200 words, B: fewer than half of the words distinct, C: more than 2 % capitals, D: a sign of
    ``#$%&*|``, E: the text of a smaller id. A document is counted once for each of its rows. Of several labels of an id
    the largest count; documents without one, or of a null id, are neither good nor toxic. Other columns aren't looked
    at. An empty table gives an empty table.

    All documents of a part with the same failures behave alike in every order, so each is counted once, in one of 32
    columns, and orders are worked out on one row for each part.
    """
    found = failures(docs, id_col, text_col, part_col)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = found.join(known, F.col("id") == F.col("_id"), "left")
    kinds = {"n": F.lit(True), "good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))}
    counts = met.groupBy("part").agg(*[
        F.coalesce(F.sum(F.when(holds & (F.col("mask") == m), F.col("times"))), F.lit(0)).alias(f"{kind}{m}") for kind, holds in kinds.items() for m in MASKS])
    counts = written(counts, "audit-counts")
    orders = [
        {"filter_order": "".join(o), "step": i + 1, "before": sum(1 << FILTERS.index(f) for f in o[:i]), "own": 1 << FILTERS.index(o[i])}
        for o in permutations(FILTERS) for i in range(len(FILTERS))]
    fixed = F.from_json(F.lit(json.dumps(orders)), "array<struct<filter_order string, step int, before int, own int>>")
    steps = counts.select("*", F.inline(fixed))
    before, own = F.col("before"), F.col("own")
    gone = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(own) != 0)
    return steps.select(
        "part", "filter_order", "step",
        over_masks("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"), over_masks("n", gone).alias("removed"),
        over_masks("n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"),
        over_masks("n", lambda m: m == own).alias("unique_fails"), over_masks("good", gone).alias("good_lost"), over_masks("toxic", gone).alias("toxic_lost"),
        # Of the orders, each failing filter of a document comes first of them in an equal part.
        over_masks("n", lambda m: m.bitwiseAND(own) != 0, lambda m: 120 // max(1, m.bit_count())).alias("shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
flagged AS (
    SELECT part, doc_id, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
        regexp_matches(t, '[#$%&*|]'), coalesce(first < doc_id, false)] AS fails FROM worded),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT f.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM flagged f LEFT JOIN known USING (doc_id)),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS l),
orders AS (SELECT [a.l, b.l, c.l, d.l, e.l] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT array_to_string(list_transform(o, lambda x: ('ABCDE')[x]), '') AS filter_order, i::INTEGER AS step, o[i] AS own, o[:i - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
groups AS (SELECT part, fails, good, toxic, count(*) AS n FROM docs GROUP BY ALL),
each AS (
    SELECT part, filter_order, step, own, n, good, toxic, fails, fails[own] AS fail, len(list_filter(before, lambda f: fails[f])) > 0 AS gone FROM groups, steps),
counted AS (
    SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fail), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fail), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (WHERE gone AND fail), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fail AND len(list_filter(fails, lambda f: f)) = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(n) FILTER (WHERE NOT gone AND fail AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE NOT gone AND fail AND toxic), 0)::BIGINT AS toxic_lost
    FROM each GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
"""
