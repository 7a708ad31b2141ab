"""Interval algebra and windowed statistics against plain loops on random data, with edges and nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import channels, detect, intervals, joins, stats

RNG = np.random.default_rng(1)


def test_points_in_bounds(spark):
    bounds = [(k + 1, float(a), float(a + w)) for k, (a, w) in enumerate(RNG.integers(0, 40, (12, 2)))]
    points = [(k, float(x)) for k, x in enumerate(RNG.uniform(-5, 90, 200))] + [(200, bounds[0][1]), (201, bounds[0][2])]
    b = spark.createDataFrame(bounds, "bound_id int, start double, end double")
    p = spark.createDataFrame(points, "id int, t double")
    for pick, best in (("last", max), ("first", min)):
        got = {r["id"]: r["bound_id"] for r in intervals.points_in_bounds(p, b, "t", 7.0, pick=pick).collect()}
        assert got == {k: best([i for i, a, z in bounds if a <= t <= z], default=0) for k, t in points}


def test_as_of_strict_and_not(spark):
    left = [(k, "ab"[k % 2], float(t)) for k, t in enumerate(RNG.integers(0, 30, 60))]
    right = [("ab"[k % 2], float(t), k) for k, t in enumerate(range(0, 30, 3))]
    a, b = spark.createDataFrame(left, "id int, c string, t double"), spark.createDataFrame(right, "c string, st double, v int")
    for strict in (True, False):
        got = {r["id"]: r["v"] for r in intervals.as_of(a, b, "t", "st", "v", ["c"], strict).collect()}
        for k, c, t in left:
            before = [(s, v) for d, s, v in right if d == c and (s < t or not strict and s == t)]
            assert got[k] == (max(before)[1] if before else None)


def test_merge_keeps_reach_of_long_bounds(spark):
    b = spark.createDataFrame([(1, 100), (5, 6), (50, 60), (103, 110), (120, 121)], "start int, end int").withColumn("c", F.lit(1))
    got = sorted((r["start"], r["end"]) for r in intervals.merge_close(b, ["c"], 4).collect())
    assert got == [(1, 110), (120, 121)]


def test_contiguous_groups(spark):
    df = spark.createDataFrame([(1, k) for k in (1, 2, 3, 4, 9, 10, 11, 12, 20, 21, 100)], "c int, k int")
    assert sorted((r["start"], r["end"], r["n"]) for r in intervals.contiguous_groups(df, ["c"], "k").collect()) == [(1, 4, 4), (9, 12, 4), (20, 21, 2), (100, 100, 1)]


def test_split(spark):
    b = spark.createDataFrame([(0.0, 10.0), (20.0, 20.5)], "start double, end double")
    assert sorted((r["part_start"], r["part_end"]) for r in intervals.split_bounds(b, 3, 1.0).collect()) == [(1, 4), (4, 7), (7, 10)]


def test_sweep_against_all_levels(spark):
    x = RNG.normal(size=300).round(1)
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "c int, i int, v double")
    got = {r["l"]: r["n"] for r in detect.level_counts(df, ["c"], "i", "v", 51).collect()}
    for level in range(51):
        over = (x > x.min() + (x.max() - x.min()) * level / 50).astype(int)
        assert got[level] == int((np.diff(np.append(0, over)) == 1).sum())
    flat = spark.createDataFrame([(1, k, 3.0) for k in range(5)], "c int, i int, v double")
    assert {r["n"] for r in detect.level_counts(flat, ["c"], "i", "v", 5).collect()} == {0}
    assert detect.duration_summary(detect.detected(df, ["c"], "i", "v"), ["c"]).count() == 1


def test_moving_average_and_bridges(spark):
    x = [None, 1.0, 4.0, None, None, 2.0, 8.0, 5.0, 7.0, None]
    df = spark.createDataFrame([(1, k + 1, v) for k, v in enumerate(x)], "c int, i int, v double")
    got = [r["smooth"] for r in stats.moving_average(df, ["c"], "i", "v", 3).orderBy("i").collect()]
    assert got == [None, 1.0, 4.0, None, None, 2.0, 5.0, pytest.approx(20 / 3), 7.0, None]
    got = [r["bridged"] for r in stats.bridge_nulls(df, ["c"], "i", "v").orderBy("i").collect()]
    assert got == pytest.approx([-2, 1, 4, 10 / 3, 8 / 3, 2, 8, 5, 7, 9])
    ends = [r["bridged"] for r in stats.bridge_nulls(df, ["c"], "i", "v", extrapolate=False).orderBy("i").collect()]
    assert ends[0] is None and ends[-1] is None


def test_flat_channels_are_left_alone(spark):
    df = spark.createDataFrame([(t, c, v) for t in range(4) for c, v in (("a", float(t)), ("b", 2.0 * t), ("flat", 9.0))], "t int, c string, v double")
    out = stats.common_average(df, ["t"], "c", "v")
    assert {r["referenced"] for r in out.filter("c = 'flat'").collect()} == {9.0}
    assert out.filter("c = 'a' and t = 2").first()["referenced"] == -1.0


def test_nearest_and_lags(spark):
    x = RNG.normal(size=(60, 3))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "r_id int, r_x array<double>")
    q = rows.filter("r_id < 5").toDF("q_id", "q_x")
    got = {}
    for r in joins.nearest(q, rows, 4).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append(r["r_id"])
    assert got == {k: np.argsort(np.linalg.norm(x - x[k], axis=1))[:4].tolist() for k in range(5)}
    a = spark.createDataFrame([(k, float(v)) for k, v in enumerate(RNG.normal(size=100))], "i int, x double")
    b = a.select((F.col("i") - 3).alias("i"), F.col("x").alias("y"))
    best = joins.lag_correlation(a, b, "i", "x", "y", 5).orderBy(F.desc("c")).first()
    assert best["lag"] == 3 and best["c"] == pytest.approx(1)


def test_epochs_must_fit(spark):
    s = spark.createDataFrame([("a", k, float(k)) for k in range(1, 8)], "ch string, idx long, value double")
    with pytest.raises(Exception, match="not a multiple"):
        channels.unstacked(s, ["ch"], 3).collect()
    t = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "t array<array<double>>")
    assert t.select(channels.flattened(F.col("t")).alias("f")).first()["f"] == [1, 3, 2, 4]
    assert [r["name"] for r in channels.amplifier_channels(spark, ["Cz ref", "", "x1"], 2).orderBy("position").collect()] == ["Cz", "A2", "x1"]
