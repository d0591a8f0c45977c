"""One transaction for each document, of the largest total score: components in tasks, an auction in rounds for the largest."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.constants import MATCHER as M
from ledgerloom.operators.components import connected_components
from ledgerloom.scratch import drop, written

#: Scores count in thousandths, bids in parts of one. The last prices differ from the best ones by a part at most.
STEPS, PARTS = 1000, 16
#: The least raise of the first bids, and the part that it is cut to in each phase.
START, FINER = 32 * PARTS, 8
#: Edges of a component that a task may hold; larger ones are auctioned.
MOST = 50_000
#: Kinds of those who bid and of what they bid for.
DOCUMENT, TRANSACTION = 0, 1


def best_edges(edges: DataFrame) -> DataFrame:
    """``(document_id, transaction_id, score, value)``: the best of repeated edges, clamped to [0, 1]; none that are null or nothing."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    best = edges.where("document_id is not null and transaction_id is not null and score is not null").groupBy("document_id", "transaction_id").agg(F.max(score).alias("score"))
    return best.withColumn("value", F.round(F.col("score") * STEPS).cast("long") * PARTS).where("value > 0")


def settled_alone(edges: DataFrame) -> DataFrame:
    """Edges that are in a best assignment for certain: worth as much as the next best edges of both their ends together."""
    by = lambda a, b: Window.partitionBy(a).orderBy(F.desc("value"), b)
    ends = []
    for own, other in (("document_id", "transaction_id"), ("transaction_id", "document_id")):
        two = edges.withColumn("place", F.row_number().over(by(own, other))).where("place <= 2")
        first = F.max_by(other, -F.col("place")).alias(other)
        ends.append(two.groupBy(own).agg(first, F.coalesce(F.max(F.when(F.col("place") == 2, F.col("value"))), F.lit(0)).alias(f"next_{own}")))
    return edges.join(ends[0], ["document_id", "transaction_id"]).join(ends[1], ["document_id", "transaction_id"]).where(
        "value >= next_document_id + next_transaction_id").select(*edges.columns)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` with ``root``, the smallest document of all that compete, directly or by way of others."""
    first = edges.groupBy("transaction_id").agg(F.min("document_id").alias("first"))
    links = edges.select("document_id", "transaction_id").join(first, "transaction_id").select("document_id", "first")
    return edges.join(connected_components(links, "document_id", "first").withColumnRenamed("node", "document_id"), "document_id")


def best_choice(offers: list[list[tuple[int, int]]], items: int) -> list[int]:
    """For each document the item that it gets in an assignment of the largest sum, or -1.

    ``offers`` are each document's items and what they are worth. Documents come one after the other and take the way
    of the least loss, over the items of others, to an item that is free or a document that had better go without.
    """
    price, owner, own, gain = [0] * items, [-1] * items, [-1] * len(offers), [0] * len(offers)
    for new, options in enumerate(offers):
        gain[new] = least = max([0, *(value - price[item] for item, value in options)])
        free, alone = -1, new  # where the best way ends: an item, or a document that goes without
        loss: dict[int, int] = {}
        before, seen, ways, d, at = {}, [], [], new, 0
        while True:
            for item, value in offers[d]:
                way = at + gain[d] - value + price[item]
                if way < least and way < loss.get(item, least):
                    loss[item], before[item] = way, d
                    if owner[item] < 0:
                        least, free, alone = way, item, -1
                    else:
                        heapq.heappush(ways, (way, item))
            while ways and ways[0][0] > loss[ways[0][1]]:
                heapq.heappop(ways)
            if not ways or ways[0][0] >= least:
                break
            at, item = heapq.heappop(ways)
            d = owner[item]
            seen.append((at, item, d))
            if at + gain[d] < least:
                least, free, alone = at + gain[d], item, d
        gain[new] -= least
        for at, item, d in seen:
            price[item] += least - at
            gain[d] -= least - at
        if alone == new:
            continue
        if alone >= 0:
            own[alone] = -1
        item, d = free, -1
        while d != new:
            d = before[item]
            owner[item], own[d], item = d, item, own[d]
    return own


def chosen(rows: pa.Table) -> pa.Table:
    """The edges of whole components that are in a best assignment; a document's edges lie together."""
    documents, items = (rows[c].combine_chunks().dictionary_encode() for c in ("document_id", "transaction_id"))
    number, value = items.indices.to_pylist(), rows["value"].to_pylist()
    starts = np.flatnonzero(np.diff(documents.indices.to_numpy(), prepend=-1)).tolist()
    offers = [[*zip(number[a:b], value[a:b], strict=True)] for a, b in zip(starts, [*starts[1:], len(number)], strict=True)]
    place = [next((a + i for i, (n, _) in enumerate(own) if n == item), -1) for a, own, item in zip(starts, offers, best_choice(offers, len(items.dictionary)), strict=True)]
    return rows.take(pa.array([p for p in place if p >= 0], pa.int64())).select(["document_id", "transaction_id", "score"])


def settling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``chosen`` of components that lie one after the other; a task holds a batch and the component that it ends in."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        root = batch.column("root").dictionary_encode().indices.to_numpy()
        last = int(np.flatnonzero(root != root[-1])[-1]) + 1 if root[0] != root[-1] else 0
        if held and (last or held[-1].column("root")[-1] != batch.column("root")[0]):
            yield from chosen(pa.Table.from_batches([*held, batch.slice(0, last)])).to_batches()
            held = []
        elif last:
            yield from chosen(pa.Table.from_batches([batch.slice(0, last)])).to_batches()
        held.append(batch.slice(last))
    if held:
        yield from chosen(pa.Table.from_batches(held)).to_batches()


def auction_graph(edges: DataFrame) -> DataFrame:
    """``(side, bidder, kind, item, value)``: documents bid for transactions, and the same once more mirrored, worth nothing.

    A document may take its own mirror and a transaction's mirror that transaction, so that nobody need go without: an
    assignment of all bidders is one of some documents, worth as much.
    """
    row = lambda side, bidder, kind, item, value: F.struct(
        F.lit(side).alias("side"), F.col(bidder).alias("bidder"), F.lit(kind).alias("kind"), F.col(item).alias("item"), value.cast("long").alias("value"))
    d, t = "document_id", "transaction_id"
    both = F.array(row(DOCUMENT, d, TRANSACTION, t, F.col("value")), row(TRANSACTION, t, DOCUMENT, d, F.lit(0)))
    own = lambda a, side, kind: edges.select(a).distinct().select(F.inline(F.array(row(side, a, kind, a, F.lit(0)))))
    return edges.select(F.inline(both)).unionByName(own(d, DOCUMENT, DOCUMENT)).unionByName(own(t, TRANSACTION, TRANSACTION))


BIDDER, ITEM = ["side", "bidder"], ["kind", "item"]


def offers(graph: DataFrame, held: DataFrame, bidders: DataFrame) -> DataFrame:
    """What each of ``bidders`` likes best at today's prices, and what the second best is worth to it."""
    open_ = graph.join(bidders, BIDDER, "left_semi").join(held.select(*ITEM, "price"), ITEM).withColumn("gain", F.col("value") - F.col("price"))
    two = open_.withColumn("place", F.row_number().over(Window.partitionBy(*BIDDER).orderBy(F.desc("gain"), *ITEM))).where("place <= 2")
    first: Column = F.col("place") == 1
    return two.groupBy(*BIDDER).agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in (*ITEM, "price", "gain")], F.max(F.when(~first, F.col("gain"))).alias("next"))


def auction(graph: DataFrame, start: int = START, most_rounds: int = 2000) -> DataFrame:
    """``(kind, item, side, bidder)``: what everyone holds in the end, worth the best total less a part for each bidder.

    In a round, all who hold nothing bid for what they like best, by what it is worth to them above their second best and
    the least raise; each item goes to the highest bid, and whoever held it is free again. Prices never fall. The least
    raise is large first and cut in phases; who would not hold what he holds at the finer one bids anew. What moves in a
    round is an edge of a free bidder, a bid, an item: no group is gathered, and bids on one item are combined in each
    task before they meet.
    """
    nobody = [F.lit(None).cast("int").alias("side"), F.lit(None).cast(graph.schema["bidder"].dataType).alias("bidder")]
    held = written(graph.select(*ITEM).distinct().select(*ITEM, F.lit(0).cast("long").alias("price"), *nobody), "held")
    bidders = written(graph.select(*BIDDER).distinct(), "bidders")
    everyone, raise_, rounds = bidders.count(), start, 0
    while True:
        while held.where("bidder is not null").count() < everyone:
            rounds += 1
            if rounds > most_rounds:
                raise RuntimeError(f"the auction did not end in {most_rounds} rounds")
            free = bidders.join(held.where("bidder is not null").select(*BIDDER), BIDDER, "left_anti")
            bids = offers(graph, held, free).select(*BIDDER, *ITEM, (F.col("price") + F.col("gain") - F.col("next") + raise_).alias("bid"))
            won = bids.groupBy(*ITEM).agg(F.max(F.struct("bid", *BIDDER)).alias("won"))
            held = replaced(held, held.join(won, ITEM, "left").select(
                *ITEM, F.coalesce("won.bid", "price").alias("price"), *[F.coalesce(F.col(f"won.{c}"), F.col(c)).alias(c) for c in BIDDER]))
        if raise_ <= 1:
            return held
        raise_ = max(1, raise_ // FINER)
        likes = offers(graph, held, bidders).select(*BIDDER, F.col("gain").alias("best"))
        leaves = held.join(graph, [*ITEM, *BIDDER]).join(likes, BIDDER).where(F.col("value") - F.col("price") < F.col("best") - raise_).select(*ITEM, F.lit(True).alias("leaves"))
        held = replaced(held, held.join(leaves, ITEM, "left").select(*ITEM, "price", *[F.when(F.col("leaves").isNull(), F.col(c)).alias(c) for c in BIDDER]))


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` written, and the table it was made from deleted."""
    out = written(new, "held")
    drop(old)
    return out


def without(edges: DataFrame, taken: DataFrame) -> DataFrame:
    """Edges of documents and transactions that are both still to be had."""
    return edges.join(taken.select("document_id"), "document_id", "left_anti").join(taken.select("transaction_id"), "transaction_id", "left_anti")


def auctioned(edges: DataFrame) -> DataFrame:
    """Edges of an assignment by auction."""
    graph = written(auction_graph(edges), "graph")
    held = auction(graph)
    drop(graph)
    pairs = held.where(f"kind = {TRANSACTION} and side = {DOCUMENT}").select(F.col("bidder").alias("document_id"), F.col("item").alias("transaction_id"))
    return edges.join(pairs, ["document_id", "transaction_id"])


def assign(edges: DataFrame, minimum: float = M.assignment_minimum, most: int = MOST) -> DataFrame:
    """``(document_id, transaction_id, score)`` of the best one-to-one assignment, without scores below ``minimum``.

    Edges are clamped to [0, 1], the best of repeated ones counts, null ends or scores are ignored; an empty table gives
    an empty table. Documents may stay alone. Scores count in thousandths. Edges that nothing else can outbid are settled
    first. Of the others, components of up to ``most`` edges are settled exactly, each within a task that reads its
    components one after the other. Larger ones are auctioned, and no task holds one of these: their sum is the largest
    there is for documents that compete with fewer than 16 documents and transactions, and within a 16th of a thousandth
    for each of them beyond.
    """
    columns = ["document_id", "transaction_id", "score"]
    every = written(best_edges(edges), "edges")
    sure = written(settled_alone(every), "settled")
    left = written(components(without(every, sure)), "components")
    drop(every)
    large = written(left.groupBy("root").count().where(F.col("count") > most).select("root"), "large")
    small = left.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root", "document_id", "transaction_id")
    done = sure.select(*columns).unionByName(small.mapInArrow(settling, left.select(*columns).schema))
    if not large.isEmpty():
        done = done.unionByName(auctioned(written(left.join(large, "root", "left_semi").drop("root"), "edges")).select(*columns))
    return done.where(F.col("score") >= minimum)
