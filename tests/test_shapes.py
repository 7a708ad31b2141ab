import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import dsp, shapes

RNG = np.random.default_rng(0)


def test_peaks(spark):
    x = np.array([0, 1, 0, 3, 2, 4, 4, 0, 2.5, 0])
    assert shapes.prominent_peaks(x).tolist() == [1, 3, 5, 8]
    assert shapes.prominent_peaks(x, min_height=2).tolist() == [3, 5, 8]
    assert shapes.prominent_peaks(x, min_prominence=1.5).tolist() == [5, 8]
    assert shapes.prominent_peaks(x, min_distance=3).tolist() == [1, 5, 8]
    df = spark.createDataFrame([("a", x.tolist())], "ch string, values array<double>")
    b = spark.createDataFrame([(1, 0.25, 0.55)], "bound_id int, start double, end double")
    assert [r["height"] for r in shapes.peaks_in_bounds(df, ["ch"], b, 10.0, 0, 0, 1).orderBy("t").collect()] == [3.0, 4.0]


def test_rectangle():
    p = RNG.uniform(size=(200, 2)) * [7, 2]
    p = np.vstack([p, [[0, 0], [7, 0], [7, 2], [0, 2]]])
    turn = np.array([[np.cos(0.6), -np.sin(0.6)], [np.sin(0.6), np.cos(0.6)]])
    assert shapes.smallest_rectangle(p @ turn.T)[0] == pytest.approx(14)


def test_clusters(spark):
    pts = [(float(cx + dx), float(cy + dy)) for cx, cy in ((0, 0), (50, 0), (0, 80)) for dx in range(3) for dy in range(3)]
    out = shapes.clusters(spark.createDataFrame(pts, "x double, y double"), "x", "y", 3)
    assert [(r["x"], r["y"]) for r in shapes.centroids(out, "x", "y").collect()] == [(1, 81), (1, 1), (51, 1)]
    img = spark.createDataFrame([("p", 2, 2, bytes([255, 0, 0, 0, 255, 0, 250, 3, 1, 9, 9, 9]))], "path string, height int, width int, data binary")
    assert [tuple(r)[1:] for r in shapes.pixels_near(img, [(255, 0, 0)], 6).orderBy("row").collect()] == [(0, 0), (1, 0)]


def test_components():
    t = np.arange(2000)
    s = np.stack([np.sin(t / 5), np.sign(np.sin(t / 17)), RNG.laplace(size=2000)])
    s = (s - s.mean(1, keepdims=True)) / s.std(1, keepdims=True)
    x = RNG.normal(size=(3, 3)) @ s
    w, v = np.linalg.eigh(np.cov(x, bias=True))
    white = (v / np.sqrt(w)).T @ (x - x.mean(1, keepdims=True))
    found = shapes.independent_components(white) @ white
    assert (np.abs(np.corrcoef(found, s)[:3, 3:]).max(0) > 0.97).all()


def test_small_things(spark):
    assert shapes.best_bin_size(100, 10, 60) == 20
    assert np.linalg.norm(shapes.compact_filter(RNG.normal(size=(4, 3)))) == pytest.approx(1)
    assert np.abs(shapes.filter_image(RNG.normal(size=(6, 2)), 0.5)).max() == 1
    xs = [0.0, 1.0, -2.5, 1234.56789, 1e-20]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(shapes.hex_of_double(F.col("x"))).collect()]
    assert [h.lower() for h in got] == [struct.pack("<d", x).hex() for x in xs]
    assert [r[0] for r in shapes.ticks(spark, 0, 1, 3).collect()] == [0, 0.5, 1]


def test_blocks_and_back(spark):
    df = spark.createDataFrame([("a", k, float(k * k)) for k in range(1, 6)], "ch string, idx int, value double")
    b = dsp.blocks(df, ["ch"], "idx", "value")
    assert b.first()["values"] == [1.0, 4.0, 9.0, 16.0, 25.0]
    assert dsp.unblocked(b, ["ch"]).orderBy("idx").collect()[2]["value"] == 9
