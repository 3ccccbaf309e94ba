"""Isotonic calibration in ranges against the max-min formula, and the bucketed interval lookup against plain search."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from parley.operators import calibrate as CAL
from parley.operators import intervals as IV


def pooled(points):
    """{x: fitted} by pool-adjacent-violators over (x, sum, weight)."""
    blocks = []
    for x, sy, w in sorted(points):
        blocks.append([sy, w, [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            sy, w, xs = blocks.pop()
            blocks[-1][0] += sy
            blocks[-1][1] += w
            blocks[-1][2] += xs
    return {x: sy / w for sy, w, xs in blocks for x in {xs[0], xs[-1]}}


SHAPES = {
    "noise": lambda r, i, n: int(r.random() < i / n),
    "rising": lambda r, i, n: int(i > n / 2),
    "falling": lambda r, i, n: int(i < n / 2),
    "saw": lambda r, i, n: int(i % 7 < 3),
    "steps": lambda r, i, n: int(r.random() < (i * 8 // n) / 8),
}


@pytest.mark.parametrize("ranges", [1, 8, 64])
def test_ranges_give_the_same_fit(spark, monkeypatch, ranges):
    rng, n, rows, want = random.Random(ranges), 640, [], {}
    for shape, label in SHAPES.items():
        points = [(i / n, label(rng, i, n)) for i in range(n) for _ in range(rng.choice([1, 1, 3]))]
        rows += [(shape, x, y) for x, y in points]
        sums = {}
        for x, y in points:
            s = sums.setdefault(x, [0, 0])
            s[0] += y
            s[1] += 1
        want[shape] = pooled([(x, sy, w) for x, (sy, w) in sums.items()])
    monkeypatch.setattr(CAL, "RANGE_ROWS", -(-n * len(SHAPES) // ranges))
    fit = CAL.fit_isotonic(spark.createDataFrame(rows, "run string, score double, y int").repartition(5))
    got = {}
    for r in fit.collect():
        assert got.setdefault(r["run"], {}).setdefault(r["x"], r["fitted"]) == r["fitted"]
    assert got == want


def test_monotone_scores_stay_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(CAL, "RANGE_ROWS", 50)
    rows = [("r", float(i), i / 1000) for i in range(1000)]
    fit = CAL.fit_isotonic(spark.createDataFrame(rows, "run string, score double, y double"))
    assert sorted((r["x"], r["fitted"]) for r in fit.collect()) == [(x, y) for _, x, y in rows]
    assert fit.rdd.getNumPartitions() > 1  # no task held all blocks


@pytest.mark.parametrize("n", [1, 2, 3, 50, 2000])
def test_lookup_equals_plain_search(spark, n):
    rng = random.Random(n)
    ends = {g: sorted({rng.choice([rng.random(), rng.random() ** 9]) for _ in range(n)}) for g in "ab"}
    intervals = [(g, a, b, i) for g, e in ends.items() for i, (a, b) in enumerate(zip([None, *e], [*e, None]))]
    values = [(g, v) for g in "abc" for v in [None, -1.0, 2.0, float("nan"), *[rng.random() ** 3 for _ in range(40)], *rng.choices(ends["a"], k=10)]]
    out = IV.lookup(spark.createDataFrame(values, "g string, v double"), spark.createDataFrame(intervals, "g string, lo double, hi double, i int"), ["g"], F.col("v"), len(intervals))
    plain = lambda g, v: None if g == "c" or v is None else len(ends[g]) if v != v else bisect.bisect_right(ends[g], v)
    assert sorted(repr((r["g"], r["v"], r["i"])) for r in out.collect()) == sorted(repr((g, v, plain(g, v))) for g, v in values)


def test_next_points(spark):
    rng = random.Random(1)
    points = [(g, x, -x) for g in "ab" for x in rng.sample(range(1000), 300)]
    out = IV.with_next(spark.createDataFrame(points, "g string, x int, y int"), ["g"], "x", ["y"], 600).collect()
    after = {(g, a): b for g in "ab" for e in [sorted(x for h, x, _ in points if h == g)] for a, b in zip(e, [*e[1:], None])}
    assert len(out) == 600 and all(r["next_x"] == after[r["g"], r["x"]] and r["next_y"] == (None if r["next_x"] is None else -r["next_x"]) for r in out)


def test_apply_has_no_nested_loop_and_handles_odd_scores(spark):
    fit = spark.createDataFrame([("r", 0.2, 0.1), ("r", 0.6, 0.5), ("one", 0.5, 0.3)], "run string, x double, fitted double")
    df = spark.createDataFrame([("r", s) for s in (0.0, 0.2, 0.4, 0.6, 1.0, None, float("nan"))] + [("one", 0.1), ("one", 0.9), ("none", 0.1)], "run string, score double")
    out = CAL.apply_isotonic(df, fit)
    got = {(r["run"], repr(r["score"])): r["p_cal"] for r in out.collect()}
    assert got["r", "None"] is None and got["r", "nan"] == 0.5
    assert [round(got["r", repr(s)], 9) for s in (0.0, 0.2, 0.4, 0.6, 1.0)] == [0.1, 0.1, 0.3, 0.5, 0.5]
    assert got["one", "0.1"] == got["one", "0.9"] == 0.3 and len(got) == 9
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
