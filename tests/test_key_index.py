"""Stored keys: lookups against a set, the files they read, batches that run again."""

from __future__ import annotations

import random

from ledgerloom.operators.dedup import unseen
from ledgerloom.operators.key_index import KeyIndex

ROWS = "id long, a string, b string, c string"
KINDS = [["a", "b"], ["c"]]


def rows(spark, seed, n, values=60):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, "", "x,y", '"', *map(str, range(values))])
    return spark.createDataFrame([(seed * 1000 + i, value(), value(), value()) for i in range(n)], ROWS)


def test_lookups_equal_those_in_all_rows(spark, tmp_path):
    index = KeyIndex(spark, f"{tmp_path}/keys", KINDS, prefixes=32)
    first, second, asked = rows(spark, 1, 40), rows(spark, 2, 40), rows(spark, 3, 200)
    assert index.unseen(asked).count() == 200
    index.add(first, 0)
    index.add(second, 1)
    index.add(second, 1)
    ids = lambda frame: sorted(r.id for r in frame.collect())
    want = ids(unseen(asked, first.union(second), KINDS))
    assert 0 < len(want) < 200 and ids(index.unseen(asked)) == want
    assert ids(index.unseen(asked, before=1)) == ids(unseen(asked, first, KINDS))  # as batch 1 would when it runs again
    assert ids(index.compacted(f"{tmp_path}/compact", 2).unseen(asked)) == want
    assert index.unseen(asked.limit(0)).count() == 0


def test_lookup_reads_the_parts_of_its_keys(spark, tmp_path):
    index = KeyIndex(spark, f"{tmp_path}/keys", KINDS, prefixes=64)
    index.add(rows(spark, 1, 600, values=5000), 0)
    few = rows(spark, 1, 3, values=5000)
    touched = [r.prefix for r in index.keyed(few).select("prefix").distinct().collect()]
    scan = index.stored(touched)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "prefix" in plan.split("PartitionFilters: [")[1].split("]")[0]
    parts = {f.rsplit("prefix=", 1)[1].split("/")[0] for f in index.stored().inputFiles()}
    read = {r.prefix for r in scan.select("prefix").distinct().collect()}
    assert len(parts) == 64 and read == set(touched) and len(read) <= 6
    assert index.unseen(few).count() == 0
