"""Numeric kernels against closed forms and invariants."""

import numpy as np
import pytest

from sigloom.operators import classify, dsp, linalg, regress, spectral, validate

RNG = np.random.default_rng(0)


def gain(sos, f, fs):
    z = np.exp(-2j * np.pi * f / fs)
    return abs(np.prod([(s[0] + s[1] * z + s[2] * z * z) / (1 + s[4] * z + s[5] * z * z) for s in sos]))


@pytest.mark.parametrize("order", [1, 2, 3, 4, 8])
@pytest.mark.parametrize("high", [False, True])
def test_butterworth(order, high):
    sos = dsp.butterworth(order, 10, 128, high)
    assert gain(sos, 10, 128) == pytest.approx(2**-0.5, abs=1e-9)
    assert gain(sos, 63.999 if high else 0, 128) == pytest.approx(1, abs=1e-6)
    assert gain(sos, 1e-6 if high else 63.999, 128) < 1e-2


def test_band_sections_known_values(spark):
    from pyspark.sql import functions as F

    sos = dsp.band_sections(8, 12, 500)
    order = np.argsort(sos[:, 4])
    assert np.allclose(sos[order][:, [0, 4, 5]], [[0.02478494, -1.95886371, 0.97002024], [0.02460586, -1.94032908, 0.96016727]], atol=1e-8)
    row = spark.range(1).select(spectral.biquad_design(F.lit(500.0), F.lit(8.0), F.lit(12.0)).alias("s")).first()["s"]
    assert np.allclose([[s["scale"], s["a1"], s["a2"]] for s in row], sos[:, [0, 4, 5]])


def test_state_carries_over():
    sos, x = dsp.butterworth(4, 10, 128), RNG.normal(size=500)
    whole = dsp.run_sections(x, sos)[0]
    a, z = dsp.run_sections(x[:200], sos)
    assert np.allclose(np.concatenate([a, dsp.run_sections(x[200:], sos, z)[0]]), whole)


def test_zero_phase_keeps_level_and_line():
    """The resting state fits a constant exactly; a line has a transient at its ends, of the reflection's length."""
    sos, x = dsp.butterworth(2, 10, 128), np.linspace(3, 5, 400)
    assert np.allclose(dsp.zero_phase(np.full(100, 7.0), sos), 7, atol=1e-9)
    assert np.allclose(dsp.zero_phase(x, sos)[50:-50], x[50:-50], atol=1e-6) and np.allclose(dsp.zero_phase(x, sos), x, atol=1e-2)


def test_filters_keep_missing_samples():
    t = np.arange(1024) / 128
    x = np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 40 * t)
    x[100:110] = np.nan
    for method in ("fft", "butter", "buttercausal"):
        y = dsp.frequency_filter(x, 128, [4, 20], "band", method)
        assert np.isnan(y).sum() == 10
        assert np.nanstd(y[300:900]) == pytest.approx(2**-0.5, rel=0.15)
    assert np.nanstd(dsp.notch_bank(np.sin(2 * np.pi * 50 * np.arange(2000) / 500), 500, 50.0)[500:1500]) < 0.05


def test_powers():
    t = np.arange(1280) / 128
    x = 2 * np.sin(2 * np.pi * 10 * t)
    assert dsp.signal_power(x, 128, [(8, 12)], "fft")[0] == pytest.approx(2, rel=1e-3)
    assert dsp.signal_power(x, 128, [(5, 15)])[0] == pytest.approx(2, rel=0.05)
    assert dsp.segmented_power(x, 128, [(8, 12), (20, 30)], 0.5, 9.5, 1.5).shape == (2, 6)
    assert dsp.band_pass_power(x, 128, 8, 12) == pytest.approx(2, rel=0.1)
    s = dsp.stft(x, 128, 128)
    assert np.isnan(s[:127]).all() and s[500].argmax() == 10


def test_cosine_codec():
    x = RNG.normal(size=83)
    back = dsp.dct_decompress(dsp.dct_compress(x, 1.0))
    assert len(back) == 83 and np.abs(back - x).max() < 0.1


def stats_of(x, y):
    names = sorted(set(y))
    return linalg.Stats(names, np.array([(y == k).sum() for k in names], float), np.array([x[y == k].mean(0) for k in names]), np.array([np.cov(x[y == k].T, bias=True) for k in names]))


def test_statistics(spark):
    x, y = RNG.normal(size=(200, 3)) + 1e6, RNG.integers(0, 3, 200)
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x)], "y int, x array<double>")
    got, want = linalg.statistics(df, "x", 3, "y"), stats_of(x, y)
    assert np.allclose(got.mean, want.mean) and np.allclose(got.cov, want.cov, atol=1e-6)
    assert np.allclose(got.total()[2], np.cov(x.T, bias=True), atol=1e-6)


def test_subspaces():
    x, y = RNG.normal(size=(300, 4)), np.repeat([0, 1, 2], 100)
    x[y == 1, 0] += 4
    x[y == 2, 1] += 4
    s = stats_of(x, y)
    t = linalg.lda(s)
    assert t.shape == (4, 2) and np.abs(t[:2]).max() > 3 * np.abs(t[2:]).max()
    w = linalg.whitening(s)
    assert np.allclose(np.cov((x @ w).T, bias=True), np.eye(4), atol=1e-8)
    assert linalg.subspaces_equal(np.eye(3)[:, :2], np.array([[1, 1], [1, -1], [0, 0.0]]))
    assert not linalg.subspaces_equal(np.eye(3)[:, :2], np.eye(3)[:, 1:])
    a = linalg.aida(s, 2)
    assert linalg.mu(np.linalg.qr(linalg.ida(s, 2))[0], s) >= linalg.mu(np.linalg.qr(a)[0], s) - 1e-9
    assert all(b.shape[0] == 4 for b in linalg.classwise_pca(s, 0.9))


def test_scorer_agrees_with_columns(spark):
    from pyspark.sql import functions as F

    x, y = RNG.normal(size=(120, 3)), np.repeat([0, 1], 60)
    x[y == 1] += 1
    s = stats_of(x, y)
    ts = linalg.classwise_pca(s, 2)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, x array<double>")
    post = [classify.posterior(classify.densities(linalg.projected(F.col("x"), t), validate.projected_stats(s, t)), s.priors) for t in ts]
    native = {r["id"]: r["d"]["decision"] for r in df.select("id", classify.over_subspaces(post).alias("d")).collect()}
    d, _, _ = validate.Scorer.of(s, ts, "quadratic", "empirical").decide(x)
    assert [native[k] for k in range(120)] == d.tolist()


def test_density_integrates_to_one():
    width, grid, density = classify.kde(np.concatenate([RNG.normal(0, 1, 100), RNG.normal(35, 2, 100)]))
    assert density.sum() * (grid[1] - grid[0]) == pytest.approx(1, abs=1e-6) and 0 < width < 5
    assert classify.kde2(RNG.normal(size=(200, 2)))[1].min() >= 0
    assert classify.elle(RNG.normal(size=(60, 3)), 2, 8).shape == (60, 2)


def test_regression(spark):
    x = RNG.normal(size=400)
    y = 3 * x + 2 + RNG.normal(0, 0.01, 400)
    y[:20] += 50
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert np.allclose(regress.robust(df, ["x"], "y"), [3, 2], atol=0.01)
    b = regress.nonlinear(lambda b, v: b[0] * np.exp(b[1] * v), x, 2 * np.exp(0.5 * x), np.array([1.0, 0.1]))
    assert np.allclose(b, [2, 0.5], atol=1e-5)
    draws = regress.surrogate_r2(spark, x[:100, None], y[100:200], 50)
    assert 0 < regress.significance(draws, 0.05) < 1


def test_folds_cover_all(spark):
    df = spark.range(103).selectExpr("id", "id % 3 label")
    sizes = [r["count"] for r in validate.folds(df, "id", 5, "label").groupBy("label", "fold").count().collect()]
    assert sum(sizes) == 103 and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("kind", ["parzen", "knn"])
def test_grid_refuses_classifiers_it_lacks(kind):
    s = linalg.Stats([0, 1], np.array([5.0, 5.0]), np.array([[0.0, 0.0], [1.0, 1.0]]), np.stack([np.eye(2)] * 2))
    assert validate.Scorer.of(s, [np.eye(2)], "linear", "empirical")
    with pytest.raises(ValueError, match=kind):
        validate.Scorer.of(s, [np.eye(2)], kind, "empirical")


def test_nearest_mean(spark):
    from pyspark.sql import functions as F

    y = np.arange(60) % 3
    x = RNG.normal(size=(60, 2)) + 2 * y[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, x array<double>")
    s = stats_of(x, y)
    got = {r["id"]: r["c"] for r in df.select("id", classify.nearest_mean(F.col("x"), s).alias("c")).collect()}
    assert [got[k] for k in range(60)] == (1 + ((x[:, None] - s.mean[None]) ** 2).sum(-1).argmin(1)).tolist()


OTHER = np.random.default_rng(1)
MEDIANS = {
    "even": OTHER.normal(size=500).tolist(),
    "odd": OTHER.normal(size=501).tolist(),
    "ties": [1.0] * 7 + [2.0] * 7 + [3.0, -4.0],
    "middle between two ties": [1.0] * 8 + [2.0] * 8,
    "one": [-3.5],
    "equal": [0.25] * 9,
    "far apart": [1e308, -1e308, 1e300, 1e-300, 5e-324, 0.0, -1e307, 2.0],
    "holes": [None, float("nan"), float("inf"), 1.0, 2.0, -float("inf"), None, 9.0, 10.0],
    "skewed": (1e9 + OTHER.exponential(size=400) ** 8).tolist(),
}


@pytest.mark.parametrize("kind", MEDIANS)
@pytest.mark.parametrize("within", [None, (-1.0, 1.0), (1e6, 2e6)])
def test_median_by_counts(spark, kind, within):
    from pyspark.sql import functions as F

    from sigloom.operators import stats

    v = MEDIANS[kind]
    finite = [x for x in v if x is not None and np.isfinite(x)]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    assert stats.median(df, F.col("x"), within, bins=3, few=2) == pytest.approx(np.median(finite), rel=1e-15)
    assert stats.median(df.filter("false"), F.col("x"), within) is None


def test_robust_by_numpy_without_percentiles(spark, monkeypatch):
    from pyspark.sql import functions as F

    x = RNG.normal(size=600)
    y = 3 * x + 2 + RNG.standard_t(2, 600)
    b = np.linalg.lstsq(a := np.column_stack([x, np.ones(600)]), y, rcond=None)[0]
    for _ in range(20):
        r = y - a @ b
        u = r / (4.685 * np.median(np.abs(r)) / 0.6745)
        w = np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0)
        b = np.linalg.solve(a.T @ (w[:, None] * a), a.T @ (w * y))
    odd = [(None, 1.0), (1.0, None), (float("inf"), 0.0)] + [(float("nan"), 1.0), (0.0, float("nan"))] * 100
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist()), *odd], "x double, y double")
    # an exact percentile brings all values that differ into one task
    for name in ("median", "percentile"):
        monkeypatch.setattr(F, name, lambda *a: pytest.fail("all residuals in one task"))
    assert regress.robust(df, ["x"], "y") == pytest.approx(b, abs=1e-6)
    assert regress.robust(df.filter("false"), ["x"], "y").tolist() == [0, 0]
    assert not spark.sparkContext._jsc.getPersistentRDDs()
