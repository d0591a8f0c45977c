"""Isotonic points over many ranges and their lookup, against one pass over everything."""

from __future__ import annotations

import random

import pytest

from ledgerloom.operators import evaluation


def points_by_force(rows):
    blocks = []
    for score, correct in sorted((s, bool(c)) for s, c in rows if s is not None):
        if blocks and blocks[-1][0] == (score, correct):
            blocks[-1][1] += correct
            blocks[-1][2] += 1
        else:
            blocks.append([(score, correct), int(correct), 1])
    out = []
    for key, hits, n in blocks:
        out.append([key[0], hits, n])
        while len(out) > 1 and out[-2][1] * out[-1][2] > out[-1][1] * out[-2][2]:
            top = out.pop()
            out[-1] = [top[0], out[-1][1] + top[1], out[-1][2] + top[2]]
    return [(i, min(1.0, max(0.0, s)), h / n) for i, (s, h, n) in enumerate(out)]


def looked_up(points, score):
    if score is None:
        return None
    if not points:
        return min(1.0, max(0.0, score))
    return next((p for _, top, p in points if score <= top), points[-1][2])


def predictions(kind, n=600):
    rng = random.Random(kind)
    score = {"rises": lambda i: i / n, "falls": lambda i: i / n, "coarse": lambda i: rng.randrange(11) / 10, "noise": lambda i: rng.random(), "wide": lambda i: rng.uniform(-0.5, 1.5)}[kind]
    hit = {"rises": lambda s: rng.random() < s, "falls": lambda s: rng.random() > s, "coarse": lambda s: rng.random() < s, "noise": lambda s: rng.random() < 0.5, "wide": lambda s: rng.random() < s}[kind]
    return [(s, None if i % 97 == 0 else hit(s)) for i in range(n) for s in [score(i)]] + [(None, True)]


@pytest.mark.parametrize("kind", ["rises", "falls", "coarse", "noise", "wide"])
def test_isotonic_over_ranges(spark, kind):
    rows = predictions(kind)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        frame = spark.createDataFrame(rows, "score double, correct boolean")
        points = evaluation.isotonic_points(frame)
        want = points_by_force(rows)
        got = sorted((r.ord, r.max_score, r.calibrated_probability) for r in points.collect())
        assert got == [(i, s, pytest.approx(p)) for i, s, p in want]
        asked = [(s,) for s, _ in rows[::3]] + [(-1.0,), (0.0,), (1.0,), (2.0,), (None,)] + [(s,) for _, s, _ in want]
        for r in evaluation.calibrated(spark.createDataFrame(asked, "score double"), points).collect():
            assert r.calibrated == (None if r.score is None else pytest.approx(looked_up(want, r.score))), r.score
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_isotonic_of_nothing(spark):
    none = spark.createDataFrame([], "score double, correct boolean")
    points = evaluation.isotonic_points(none)
    assert points.count() == 0
    got = evaluation.calibrated(spark.createDataFrame([(0.25,), (7.0,), (None,)], "score double"), points).collect()
    assert sorted((r.score or 0, r.calibrated) for r in got) == [(0, None), (0.25, 0.25), (7.0, 1.0)]
