"""Values of queries that have no SQL, against numpy and the standard library."""

import os
import zlib

import numpy as np
import pytest

from sigloom.plans import catalogue, catalogue2, catalogue3  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def plane(spark):
    rows = catalogue2.vectors(spark, DATA).orderBy("vec_id").collect()
    return [r["vec_id"] for r in rows], np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])


def table(spark, name, ids):
    got = {(r["vec_id"], r["k"]): r["v"] for r in catalogue.QUERIES[name](spark, DATA).collect()}
    width = 1 + max(k for _, k in got)
    return np.array([[got[i, k] for k in range(width)] for i in ids])


def test_pca_project(spark, plane):
    ids, x, _ = plane
    got = table(spark, "pca_project", ids)
    w, v = np.linalg.eigh(np.cov(x.T))
    w, v = w[::-1], v[:, ::-1]
    k = got.shape[1]
    assert np.cumsum(w)[k - 1] >= 0.9 * w.sum() > (np.cumsum(w)[k - 2] if k > 1 else 0)
    assert np.allclose(np.abs(got), np.abs(x @ v[:, :k]), atol=2e-6)


def test_whiten(spark, plane):
    ids, *_ = plane
    assert np.allclose(np.cov(table(spark, "whiten", ids).T, bias=True), np.eye(8), atol=1e-4)


def test_lda_project(spark, plane):
    """The directions' ratios of between- to within-class scatter are the largest eigenvalues."""
    ids, x, label = plane
    got = table(spark, "lda_project", ids)

    def scatter(z):
        parts = [z[label == c] for c in np.unique(label)]
        within = sum(np.cov(p.T, bias=True).reshape(z.shape[1], -1) * len(p) for p in parts) / len(z)
        return within, np.cov(z.T, bias=True).reshape(z.shape[1], -1) - within

    within, between = scatter(x)
    best = np.sort(np.linalg.eigvals(np.linalg.solve(within, between)).real)[::-1]
    w, b = scatter(got)
    assert np.sort(np.linalg.eigvals(np.linalg.solve(w, b)).real)[::-1] == pytest.approx(best[: got.shape[1]], rel=1e-4)


def test_fkt(spark, plane):
    _, x, label = plane
    s = [x[label % 2 == k].T @ x[label % 2 == k] / (label % 2 == k).sum() for k in range(2)]
    lam = np.sort(np.linalg.eigvals(np.linalg.solve(s[0] + s[1], s[0])).real)[::-1]
    got = [r["eigenvalue"] for r in catalogue.QUERIES["fkt"](spark, DATA).orderBy("k").collect()]
    assert got == pytest.approx([*lam[:2], *lam[-2:]], abs=1e-5)


def test_crc32_name(spark):
    names = {r["p_partkey"]: r["p_name"] for r in catalogue.load(spark, DATA, "part").collect()}
    for r in catalogue.QUERIES["crc32_name"](spark, DATA).collect():
        assert int(r["crc"], 16) == zlib.crc32(names[r["k"]].encode())


def test_robust_regression(spark):
    rows = catalogue.load(spark, DATA, "lineitem").select("l_quantity", "l_extendedprice").toPandas().to_numpy(float)
    got = {r["term"]: r["value"] for r in catalogue.QUERIES["robust_regression"](spark, DATA).collect()}
    a, y = np.column_stack([rows[:, 0], np.ones(len(rows))]), rows[:, 1]
    plain = np.linalg.lstsq(a, y, rcond=None)[0]
    rest = np.abs(y - a @ np.array([got["l_quantity"], got["const"]]))
    assert np.median(rest) <= np.median(np.abs(y - a @ plain)) * 1.01


def test_outlier_distances(spark, plane):
    ids, x, _ = plane
    got = {r["vec_id"]: (r["score"], r["orthogonal"]) for r in catalogue.QUERIES["outlier_distances"](spark, DATA).collect()}
    z = x - x.mean(0)
    w, v = np.linalg.eigh(np.cov(x.T))
    w, v = w[::-1][:4], v[:, ::-1][:, :4]
    scores = z @ v
    assert [got[i][0] for i in ids] == pytest.approx(np.sqrt((scores**2 / w).sum(1)).tolist(), abs=1e-5)
    assert [got[i][1] for i in ids] == pytest.approx(np.linalg.norm(z - scores @ v.T, axis=1).tolist(), abs=1e-5)
