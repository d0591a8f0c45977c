"""Connected components of an edge table, by pointers to ever smaller nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.scratch import drop, written


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """One row ``(node, root)`` for each node that an edge names; root is the smallest node of its component.

    Edges with a null end are ignored, loops and repeats do no harm, an empty table gives an empty table.

    Each edge points from its larger to its smaller end. A round keeps the smallest pointer of every node, hands the
    other pointers down to it, and lets every pointer skip one step. Aggregates combine before their shuffle and the
    joins' keys may be hot on one side only, so that adaptive execution can split them; a round emits at most one row
    for each row it reads and one for each node.
    """
    x, y = F.col(a), F.col(b)
    links = edges.where(x.isNotNull() & y.isNotNull()).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
    isolated = links.where("hi = lo").select("hi")
    state = written(links.where("hi <> lo").distinct().withColumn("moved", F.lit(True)), "components")
    nodes = written(isolated.distinct(), "loops")
    for _ in range(max_rounds):
        lowest = state.groupBy("hi").agg(F.min("lo").alias("low"))
        handed = (
            state.select("hi", "lo").join(lowest, "hi").where("lo <> low")
            .select(F.col("lo").alias("hi"), F.col("low").alias("lo"), F.lit(True).alias("moved"))
        )
        further = lowest.select(F.col("hi").alias("low"), F.col("low").alias("next"))
        skipped = lowest.join(further, "low", "left").select(
            "hi", F.coalesce("next", "low").alias("lo"), F.col("next").isNotNull().alias("moved")
        )
        step = written(
            handed.unionByName(skipped).groupBy("hi", "lo").agg(F.max("moved").alias("moved")), "components"
        )
        drop(state)
        state = step
        if step.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pointers = state.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    roots = pointers.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    settled = pointers.unionByName(roots)
    alone = nodes.select(F.col("hi").alias("node")).join(settled, "node", "left_anti")
    return settled.unionByName(alone.withColumn("root", F.col("node")))
