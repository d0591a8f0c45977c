"""Ranking, automation and calibration metrics of labelled predictions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.constants import MATCHER as M
from ledgerloom.functions.text import clamp01
from ledgerloom.scratch import drop, written


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(predictions: DataFrame) -> DataFrame:
    auto, correct = F.col("auto_matched"), F.col("correct")
    return predictions.agg(
        F.count_if(auto & correct).alias("true_positives"), F.count_if(auto & ~correct).alias("false_positives"),
        F.count_if(~auto & ~correct).alias("true_negatives"), F.count_if(~auto & correct).alias("false_negatives"))


def recall_at(predictions: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row per k, also for no predictions."""
    hit = lambda k: F.avg(F.coalesce(F.col("rank_of_correct") <= k, F.lit(False)).cast("double"))
    wide = predictions.agg(*[F.coalesce(hit(k), F.lit(0.0)).alias(str(k)) for k in ks])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("recall")) for k in ks])).alias("r")).select("r.k", "r.recall")


def bins(predictions: DataFrame, count: int = 10) -> DataFrame:
    """Members, mean score and share correct of each equal bin of the score; the last one is closed."""
    score = clamp01(F.col("score"))
    number = F.least(F.floor(score * count), F.lit(count - 1)).cast("int")
    return predictions.groupBy(number.alias("bin")).agg(
        F.count("*").alias("members"), F.avg(score).alias("mean_score"), F.avg(F.col("correct").cast("double")).alias("share_correct"))


def metrics(predictions: DataFrame) -> DataFrame:
    """All metrics as one row; zeros, and nulls for precision and recall, where there is nothing to measure."""
    c = F.col
    counts = confusion(predictions).crossJoin(predictions.agg(  # one row each
        F.count("*").alias("examples"), F.avg(c("correct").cast("double")).alias("top1"),
        F.avg(F.pow(clamp01(c("score")) - c("correct").cast("double"), 2)).alias("brier")))
    error = bins(predictions).agg(
        F.sum(c("members") * F.abs(c("mean_score") - c("share_correct"))).alias("missed"), F.sum("members").alias("all"))
    auto = c("true_positives") + c("false_positives")
    return counts.crossJoin(error).select(
        "examples", F.coalesce("top1", F.lit(0.0)).alias("top1_accuracy"), "true_positives", "false_positives", "true_negatives", "false_negatives",
        _ratio(c("false_positives"), c("false_positives") + c("true_negatives")).alias("false_positive_rate"),
        _ratio(c("false_negatives"), c("false_negatives") + c("true_positives")).alias("false_negative_rate"),
        _ratio(auto, c("examples")).alias("auto_coverage"), F.when(c("examples") == 0, 0.0).otherwise(1 - auto / c("examples")).alias("review_rate"),
        F.when(auto > 0, c("true_positives") / auto).alias("auto_precision"),
        F.when(c("true_positives") + c("false_negatives") > 0, c("true_positives") / (c("true_positives") + c("false_negatives"))).alias("auto_recall"),
        F.coalesce("brier", F.lit(0.0)).alias("brier_score"), F.coalesce(c("missed") / c("all"), F.lit(0.0)).alias("expected_calibration_error"))


def report(predictions: DataFrame, target: float = 0.995, enough: int = 100) -> DataFrame:
    """``(report, warning)``, one row: metrics and the recommended threshold as JSON; a warning below ``enough`` examples."""
    found = metrics(predictions)
    best = threshold(predictions, target).agg(F.first(F.struct("threshold", "precision", "coverage")).alias("recommended_threshold"))
    both = found.crossJoin(F.broadcast(best))  # one row each
    text = F.to_json(F.struct(F.struct(*found.columns).alias("metrics"), "recommended_threshold"))
    return both.select(text.alias("report"), F.when(F.col("examples") < enough, f"fewer than {enough} labelled examples").alias("warning"))


def threshold(predictions: DataFrame, target: float = 0.995) -> DataFrame:
    """The lowest score from which on the share correct reaches the target: (threshold, precision, coverage), or no row.

    Rows are first summed by score; the running sums from the top are of the distinct scores. Scores are dealt by
    hundredths, so that only the sums of the hundredths pass through one window.
    """
    each = predictions.groupBy(clamp01(F.col("score")).alias("threshold")).agg(
        F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("hits")).withColumn("part", F.floor(F.col("threshold") * 100))
    parts = each.groupBy("part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"), F.coalesce(F.sum("hits").over(above), F.lit(0)).alias("hits_above"), F.sum("n").over(Window.partitionBy()).alias("all"))
    within = Window.partitionBy("part").orderBy(F.desc("threshold"))
    tail = each.join(base, "part").select(
        "threshold", (F.sum("n").over(within) + F.col("n_above")).alias("n"), (F.sum("hits").over(within) + F.col("hits_above")).alias("hits"), "all")
    good = tail.where(F.col("hits") / F.col("n") >= target).select("threshold", (F.col("hits") / F.col("n")).alias("precision"), (F.col("n") / F.col("all")).alias("coverage"))
    return good.orderBy("threshold").limit(1)


BLOCK = "part int, score double, correct boolean, hits long, n long"


def pooled(rows: pd.DataFrame, blocks: list[list] | None = None) -> list[list]:
    """Blocks of neighbours in order, so that no block's share correct is larger than the next one's."""
    blocks = [] if blocks is None else blocks
    for part, score, correct, hits, n in rows[["part", "score", "correct", "hits", "n"]].itertuples(index=False):
        blocks.append([part, score, correct, hits, n])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][4] > blocks[-1][3] * blocks[-2][4]:
            _, _, _, hits, n = blocks.pop(-2)
            blocks[-1][3] += hits
            blocks[-1][4] += n
    return blocks


def isotonic_blocks(predictions: DataFrame) -> DataFrame:
    """``(part, score, correct, hits, n)``: the blocks of pool-adjacent-violators, each as its last score and label, by range.

    Rows are summed by distinct score and label and dealt into ranges of these. What violates the order within a range
    does so in the whole, so each range is pooled by a task of its own. Then neighbouring ranges are pooled two by two,
    the even and the odd pairs by turns, until a turn of either changes nothing: no neighbours are left to pool then. A
    block stays in the range of its last score, so a group never holds more than two ranges.
    """
    correct = F.coalesce("correct", F.lit(False))
    each = predictions.where("score is not null").groupBy("score", correct.alias("correct")).agg(F.count("*").alias("n"))
    summed = each.select(F.lit(0).alias("part"), "score", "correct", F.when(F.col("correct"), F.col("n")).otherwise(0).alias("hits"), "n")

    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: list[list] = []
        for frame in frames:
            pooled(frame.assign(part=TaskContext.get().partitionId()), blocks)
        yield pd.DataFrame(blocks, columns=["part", "score", "correct", "hits", "n"])

    def together(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(pooled(group.sort_values(["score", "correct"])), columns=["part", "score", "correct", "hits", "n"])

    ranges = summed.repartitionByRange("score", "correct").sortWithinPartitions("score", "correct")
    blocks = written(ranges.mapInPandas(within, BLOCK), "blocks")
    count, still, odd = blocks.count(), 0, 0
    while still < 2:
        places = blocks.select("part").distinct().withColumn("place", F.row_number().over(Window.orderBy("part")) - 1)  # a row a range
        pairs = blocks.join(F.broadcast(places), "part").withColumn("pair", F.floor((F.col("place") + odd) / 2))
        new = written(pairs.groupBy("pair").applyInPandas(together, BLOCK), "blocks")
        drop(blocks)
        left = new.count()
        still, odd = (still + 1 if left == count else 0), 1 - odd
        blocks, count = new, left
    return blocks


def isotonic_points(predictions: DataFrame) -> DataFrame:
    """``(ord, max_score, calibrated_probability)``: pool-adjacent-violators over predictions in order of score.

    Of equal scores the incorrect come first, neighbours of an equal share stay apart, null scores don't count, no
    predictions give no points. Blocks are numbered within their ranges and ranges by their sizes.
    """
    blocks = isotonic_blocks(predictions)
    sizes = blocks.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("part").orderBy("score", "correct"))
    return blocks.withColumn("place", place).join(F.broadcast(before), "part").select(
        (F.col("before") + F.col("place") - 1).cast("long").alias("ord"), clamp01(F.col("score")).alias("max_score"), (F.col("hits") / F.col("n")).alias("calibrated_probability"))


def calibrated(rows: DataFrame, points: DataFrame) -> DataFrame:
    """``rows`` with calibrated: the probability of the first point at or above the score, beyond the last the last's.

    Without points it is the score itself, clamped; a null score has none. Each distinct score is looked up once, among
    the points of its hundredth and the first of those that follow, so no task sees all points or a score's many rows.
    """
    part = lambda c: F.floor(clamp01(F.col(c)) * 100).cast("int").alias("part")
    steps = points.select(F.col("max_score").alias("at"), "ord", F.col("calibrated_probability").alias("value"), part("max_score"))
    scores = rows.where("score is not null").select(F.col("score").alias("at")).distinct().select("at", F.lit(-1).cast("long").alias("ord"), F.lit(None).cast("double").alias("value"), part("at"))
    onward = Window.partitionBy("part").orderBy("at", "ord").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own = scores.unionByName(steps).withColumn("found", F.first("value", ignorenulls=True).over(onward)).where("ord = -1")
    hundredths = rows.sparkSession.range(101).select(F.col("id").cast("int").alias("part"))
    firsts = hundredths.join(steps.groupBy("part").agg(F.min_by("value", "ord").alias("value")), "part", "left")
    later = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    following = firsts.select("part", F.first("value", ignorenulls=True).over(later).alias("later"))  # 101 rows
    last = steps.agg(F.max_by("value", "ord").alias("last"))  # one row
    known = own.join(F.broadcast(following), "part").crossJoin(F.broadcast(last)).select(
        F.col("at").alias("score"), F.coalesce("found", "later", "last", clamp01(F.col("at"))).alias("calibrated"))
    return rows.join(known, "score", "left").select(*rows.columns, "calibrated")


def labelled_from_events(events: DataFrame) -> DataFrame:
    """``(event_id, score, correct, auto_matched, rank_of_correct)`` from reviewers' decisions and their snapshots.

    A confirmation is a label; a rejection is one where it left a single open candidate. Candidates are ranked by
    decision confidence, then by rank, unknown ranks last.
    """
    ordered = F.array_sort(F.transform("candidate_snapshot", lambda c: F.struct(
        (-c["decision_confidence"]).alias("down"), F.coalesce(c["rank"], F.lit(999)).alias("rank"), c["transaction_id"].alias("transaction_id"),
        c["decision_confidence"].alias("decision_confidence"), c["evidence_coverage"].alias("evidence_coverage"), F.size(c["contradictions"]).alias("contradictions"))))
    open_ = F.size(F.filter("candidate_snapshot", lambda c: c["status"] == "CANDIDATE"))
    confirm = F.col("action") == "CONFIRM"
    rows = events.where((confirm | (open_ == 1)) & (F.size("candidate_snapshot") > 0)).withColumn("ranked", ordered)
    top, second = F.col("ranked")[0], F.get("ranked", F.lit(1))
    gap = top["decision_confidence"] - F.coalesce(second["decision_confidence"], F.lit(0.0))
    place = F.array_position(F.transform("ranked", lambda c: c["transaction_id"]), F.col("transaction_id"))
    return rows.select(
        F.col("id").alias("event_id"), top["decision_confidence"].alias("score"),
        (confirm & (top["transaction_id"] == F.col("transaction_id"))).alias("correct"),
        ((top["decision_confidence"] >= M.auto) & (gap >= M.gap) & (top["evidence_coverage"] >= M.min_coverage) & (top["contradictions"] == 0)).alias("auto_matched"),
        F.when(confirm & (place > 0), place.cast("int")).alias("rank_of_correct"))
