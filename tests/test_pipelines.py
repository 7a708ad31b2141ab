"""Procedures on data whose answer is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import channels, linalg, regress
from sigloom.plans import pipelines

RNG = np.random.default_rng(2)
GRID = [("cpca", 2, "aida", 2, "quadratic"), ("none", 0, "lda", 1, "linear")]


@pytest.fixture(scope="module")
def classes(spark):
    y = np.repeat([0, 1, 2], 60)
    x = RNG.normal(size=(180, 4))
    x[y == 1, 0] += 6
    x[y == 2, 1] += 6
    return spark.createDataFrame([(k, int(c), v.tolist()) for k, (c, v) in enumerate(zip(y, x))], "id int, label int, x array<double>")


def test_report(classes):
    even, odd = classes.filter("id % 2 = 0"), classes.filter("id % 2 = 1")
    rows = pipelines.report(even, odd, "id", "label", "x", 4, GRID, 2).collect()
    assert {r["rank"] for r in rows} == {1, 2} and max(r["pcorrect"] for r in rows) > 0.95 and all(r["runs"] == 2 for r in rows)
    lonely = odd.unionByName(odd.limit(1).withColumn("label", F.lit(9)))
    assert pipelines.split_validated(even, lonely, "label", "x", 4, GRID).count() == 2


def test_balanced(classes):
    some = classes.filter("label > 0 or id < 10")
    assert {r["count"] for r in pipelines.balanced(some, "id", "label", 0).groupBy("label").count().collect()} == {10}


def test_classwise_decoder(classes):
    scorer, names = pipelines.train_classwise(classes, "label", "x", 4, 2)
    x = np.array([r["x"] for r in classes.orderBy("id").collect()])
    y = np.array([r["label"] for r in classes.orderBy("id").collect()])
    assert np.mean(np.array(names)[scorer.decide(x)[0] - 1] == y) > 0.95


def test_binned_decoder(spark):
    rows = [(k % 2, (RNG.normal(size=40) + (k % 2) * np.repeat([0, 3], 20)).tolist()) for k in range(80)]
    df = spark.createDataFrame(rows, "label int, values array<double>")
    assert df.limit(1).select(pipelines.binned(F.array(*map(F.lit, [1.0, 3.0, 5.0, 7.0, 9.0])), 2).alias("b")).first()["b"] == [2, 6]
    d = pipelines.train_binned(df, "label", "values", 40, 1)
    f = np.array([(r["label"], r["f"][0]) for r in df.select("label", d.features(F.col("values")).alias("f")).collect()])
    a, b = f[f[:, 0] == 0, 1], f[f[:, 0] == 1, 1]
    assert d.size >= 2 and abs(a.mean() - b.mean()) > 3 * max(a.std(), b.std()) / 2


def test_rules_per_class(classes):
    s = linalg.statistics(classes, "x", 4, "label")
    assert [b.shape[1] for b in linalg.classwise_pca(s, [1, 2, 3])] == [3, 4, 4] or all(b.shape[1] >= k for k, b in enumerate(linalg.classwise_pca(s, [1, 2, 3]), 1))


def test_leave_one_out(spark):
    x = RNG.normal(size=20)
    y = 2 * x + 1 + RNG.normal(size=20)
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "id int, x double, y double")
    got = {r["id"]: r["loo"] for r in regress.leave_one_out(df, ["x"], "y").collect()}
    for k in range(20):
        keep = np.arange(20) != k
        assert got[k] == pytest.approx(np.polyval(np.polyfit(x[keep], y[keep], 1), x[k]))


def test_coordinates(spark):
    p = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, 0)], "pos int, x int, y int")
    w = spark.createDataFrame([(0, 0), (1, 0), (5, 5)], "x int, y int")
    assert {(r["x"], r["y"]): r["pos"] for r in channels.found_coordinates(w, p).collect()} == {(0, 0): 1, (1, 0): None, (5, 5): None}
