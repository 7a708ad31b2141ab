"""Subspaces from sufficient statistics: counts, sums and second moments are aggregated by Spark, small eigenproblems are solved
on the driver (their size is the number of dimensions, not of rows), and the matrices go back into native projections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Stats:
    """Per class: name, count, mean, and the population covariance."""

    names: list
    n: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    def sample_cov(self) -> np.ndarray:
        return self.cov * (self.n / np.maximum(self.n - 1, 1))[:, None, None]

    @property
    def priors(self) -> np.ndarray:
        return self.n / self.n.sum()

    def total(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Count, mean and population covariance of all rows."""
        p = self.priors
        m = p @ self.mean
        off = self.mean - m
        return int(self.n.sum()), m, np.einsum("c,cij->ij", p, self.cov) + np.einsum("c,ci,cj->ij", p, off, off)


def statistics(df: DataFrame, x: str, dims: int, label: str | None = None, seed_mean: bool = True) -> Stats:
    """One pass of hash aggregation: dims + dims (dims + 1) / 2 sums per class, added up before the shuffle.

    Sums are taken about a first estimate of the mean (one cheap pass), so large offsets don't eat the covariance's digits.
    """
    key = F.col(label) if label else F.lit(0)
    v = [F.col(x)[i].cast("double") for i in range(dims)]
    about = df.agg(*[F.avg(c) for c in v]).first() if seed_mean else [0.0] * dims
    v = [c - (a or 0.0) for c, a in zip(v, about)]
    sums = [F.sum(c) for c in v] + [F.sum(v[i] * v[j]) for i in range(dims) for j in range(i, dims)]
    rows = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"), *[s.alias(f"s{q}") for q, s in enumerate(sums)]).orderBy("k").collect()
    n = np.array([r["n"] for r in rows], float)
    s = np.array([[r[f"s{q}"] for q in range(len(sums))] for r in rows], float).reshape(len(rows), -1)
    mean = s[:, :dims] / n[:, None]
    cov = np.zeros((len(rows), dims, dims))
    at = dims
    for i in range(dims):
        for j in range(i, dims):
            cov[:, i, j] = cov[:, j, i] = s[:, at] / n - mean[:, i] * mean[:, j]
            at += 1
    return Stats([r["k"] for r in rows], n, mean + np.array([a or 0.0 for a in about]), cov)


def means(df: DataFrame, x: str, dims: int, label: str) -> tuple[list, list[list[float | None]]]:
    """Per class (a null one comes last): its name, and the mean of each dimension over the values that aren't null."""
    rows = df.groupBy(F.col(label).alias("k")).agg(*[F.avg(F.get(x, F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dims)]).orderBy(F.col("k").asc_nulls_last()).collect()
    return [r["k"] for r in rows], [[r[f"m{i}"] for i in range(dims)] for r in rows]


def canonical(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive: eigenvectors are only defined up to a sign."""
    if not vectors.size:
        return vectors
    top = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return vectors * np.where(top < 0, -1, 1)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first (tiny ones as 0), and vectors."""
    w, v = np.linalg.eigh((a + a.T) / 2)
    w, v = w[::-1], v[:, ::-1]
    return np.where(w < np.finfo(float).eps, 0, w), canonical(v)


def kept(w: np.ndarray, rule: float = 0.0) -> int:
    """How many components a rule keeps: 0 (or -1 and less): those over the mean of the positive; -1..0: over that part of the
    largest; 0..1: as many as reach that share of the sum; 1 and more: so many, of the positive."""
    positive = int((w > 0).sum())
    if not positive:
        return 0
    if rule <= -1 or rule == 0:
        return int((w > w[w > 0].mean()).sum()) or 1
    if rule < 0:
        return int((w / w[0] > -rule).sum())
    if rule < 1:
        return int(np.searchsorted(np.cumsum(w) / w.sum(), rule - 1e-12) + 1)
    return min(positive, int(rule))


def pca(stats: Stats, rule: float = 0.0) -> np.ndarray:
    n, _, cov = stats.total()
    w, v = eigen(cov * n / max(n - 1, 1))
    return v[:, : kept(w, rule)]


def orth(a: np.ndarray) -> np.ndarray:
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    return canonical(u[:, s > max(a.shape) * np.spacing(s[0])]) if s.size and s[0] > 0 else np.zeros((a.shape[0], 0))


def classwise_pca(stats: Stats, rule: float | Sequence[float] = 0.0) -> list[np.ndarray]:
    """One basis per class: its own components, by one rule or one per class, with those of the class means."""
    rules = list(rule) if isinstance(rule, (list, tuple)) else [rule] * len(stats.n)
    _, m, _ = stats.total()
    between = np.sqrt(stats.priors)[:, None] * (stats.mean - m)
    wb, vb = eigen(between.T @ between)
    vb = vb[:, : int((wb > 1e-12 * max(wb[0], 1e-300)).sum())]
    out = []
    for cov, own in zip(stats.sample_cov(), rules):
        w, v = eigen(cov)
        out.append(orth(np.hstack([v[:, : kept(w, own)], vb])))
    return out


def combined_pca(stats: Stats, rule: float = 0.0) -> list[np.ndarray]:
    """The classes' bases and one of all rows."""
    return [*classwise_pca(stats, rule), pca(stats, rule)]


def function_of(a: np.ndarray, f) -> np.ndarray:
    w, v = np.linalg.eigh((a + a.T) / 2)
    return (v * f(w)) @ v.T


def inverse_root(a: np.ndarray) -> np.ndarray:
    floor = max(np.linalg.eigvalsh(a)[-1] * 1e-12, 1e-300)
    return function_of(a, lambda w: 1 / np.sqrt(np.maximum(w, floor)))


def lda(stats: Stats, m: int | None = None) -> np.ndarray:
    """Directions of the largest ratio of scatter between to within classes, at most classes - 1 of them."""
    sw = np.einsum("c,cij->ij", stats.priors, stats.cov)
    sb = stats.total()[2] - sw
    half = inverse_root(sw)
    _, v = eigen(half @ sb @ half)
    v = half @ v[:, : min(m or len(stats.n) - 1, len(stats.n) - 1)]
    return canonical(v / np.linalg.norm(v, 2)) if v.size else v


def aida(stats: Stats, m: int) -> np.ndarray:
    """Approximate information discriminant directions: the spectrum of log S - sum of p log S_k, after whitening within classes."""
    if stats.mean.shape[1] <= m:
        return np.eye(stats.mean.shape[1])
    cov, p = stats.sample_cov(), stats.priors
    sw = np.einsum("c,cij->ij", p, cov)
    m0 = p @ stats.mean
    total = sw + np.einsum("c,ci,cj->ij", p, stats.mean - m0, stats.mean - m0)
    half, log = inverse_root(sw), lambda a: function_of(a, lambda w: np.log(np.maximum(w, 0) + np.finfo(float).eps))
    z = log(half @ total @ half) - sum(pk * log(half @ sk @ half) for pk, sk in zip(p, cov))
    _, v = eigen(z)
    f = v[:, :m].T @ half
    return canonical((f / np.linalg.norm(f, 2)).T)


def mu(t: np.ndarray, stats: Stats) -> float:
    """The information discriminant of a transform t (dims x m)."""
    cov, p = stats.sample_cov(), stats.priors
    m0 = p @ stats.mean
    total = np.einsum("c,cij->ij", p, cov) + np.einsum("c,ci,cj->ij", p, stats.mean - m0, stats.mean - m0)
    logdet = lambda a: np.linalg.slogdet(t.T @ a @ t)[1]
    return 0.5 * (logdet(total) - sum(pk * logdet(sk) for pk, sk in zip(p, cov)))


def ida(stats: Stats, m: int, restarts: int = 5, steps: int = 200, seed: int = 3) -> np.ndarray:
    """Raises mu by gradient steps on orthonormal transforms from the approximate solution and from seeded random ones."""
    rng = np.random.default_rng(seed)
    cov, p = stats.sample_cov(), stats.priors
    m0 = p @ stats.mean
    total = np.einsum("c,cij->ij", p, cov) + np.einsum("c,ci,cj->ij", p, stats.mean - m0, stats.mean - m0)
    part = lambda t, a: a @ t @ np.linalg.pinv(t.T @ a @ t)
    best = None
    for k in range(restarts + 1):
        t = np.linalg.qr(aida(stats, m) if not k else rng.normal(size=(total.shape[0], m)))[0]
        value, size = mu(t, stats), 1.0
        for _ in range(steps):
            g = part(t, total) - sum(pk * part(t, sk) for pk, sk in zip(p, cov))
            new = np.linalg.qr(t + size * g)[0]
            if (v := mu(new, stats)) > value:
                t, value, size = new, v, size * 1.5
            elif (size := size / 3) < 1e-9:
                break
        if best is None or value > best[0] + 1e-12:
            best = (value, t)
    return canonical(best[1])


def fkt(stats: Stats, first: float = 0, second: float = 0, reduced: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Fukunaga-Koontz directions of two classes, from moments about the origin, and their eigenvalues, largest first.

    first and second say which stay for either class (second: as first, if left out by None): both 0, eigenvalues over 0.9 and under 0.1;
    under 1, those over 1 - first and under second; from 1, so many from either end. reduced: where a class's moments aren't of
    full rank, principal components come first, as many as the smaller rank.
    """
    first = max(first, 0)
    second = first if second is None else max(second, 0)
    s = [c + np.outer(m, m) for c, m in zip(stats.cov, stats.mean)][:2]
    before = np.eye(len(s[0]))
    rank = min(int((w > 1e-18 * w[0]).sum()) for w in (eigen(x)[0] for x in s))
    if reduced and rank < min(len(before), *stats.n[:2]):
        before = pca(stats, rank)
        s = [before.T @ x @ before for x in s]
    w, v = eigen(s[0] + s[1])
    ok = w > 1e-9 * w[0]
    white = v[:, ok] / np.sqrt(w[ok])
    lam, u = eigen(white.T @ s[0] @ white)
    at = np.zeros(len(lam), bool)
    if not first and not second:
        at |= (lam > 0.9) | (lam < 0.1)
    else:
        at |= (lam > 1 - first) if first < 1 else (np.arange(len(lam)) < first)
        at |= (lam < second) if second < 1 else (np.arange(len(lam)) >= len(lam) - second)
    return before @ white @ u[:, at], lam[at]


def whitening(stats: Stats, symmetric: bool = False) -> np.ndarray:
    """W with unit population covariance of x W; a negative eigenvalue is an error."""
    w, v = np.linalg.eigh(stats.total()[2])
    if (w < -1e-10 * max(abs(w))).any():
        raise ValueError("the covariance has a negative eigenvalue")
    ok = w > 1e-12 * w[-1]
    out = canonical(v[:, ok]) / np.sqrt(w[ok])
    return out @ canonical(v[:, ok]).T if symmetric else out


def subspaces_equal(a: np.ndarray, b: np.ndarray, tol: float | None = None) -> bool:
    """Whether each basis spans the other."""
    tol = tol or 1e-10 * len(a)
    left = lambda p, q: np.abs(p @ np.linalg.lstsq(p, q, rcond=None)[0] - q).max() if q.size else 0.0
    return left(a, b) < tol and left(b, a) < tol


def projected(x: Column, t: np.ndarray, mean: Sequence[float] | None = None) -> Column:
    """x (array) times t as an array expression; t's numbers are part of the plan."""
    v = F.transform(x, lambda e: e.cast("double"))
    if mean is not None:
        v = F.zip_with(v, F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    columns = F.array(*[F.array(*[F.lit(float(e)) for e in c]) for c in np.asarray(t).T])
    return F.transform(columns, lambda c: F.aggregate(F.zip_with(v, c, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e))


def outlier_distances(df: DataFrame, x: str, stats: Stats, rule: float = 0.0) -> DataFrame:
    """Score distance and orthogonal distance of every row to the principal subspace."""
    n, m, cov = stats.total()
    w, v = eigen(cov * n / max(n - 1, 1))
    k = kept(w, rule)
    scores = projected(F.col(x), v[:, :k], m)
    lam = F.array(*[F.lit(float(e)) for e in w[:k]])
    total = F.aggregate(F.zip_with(F.col(x), F.array(*[F.lit(float(e)) for e in m]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e)
    inside = F.aggregate(scores, F.lit(0.0), lambda s, e: s + e * e)
    return df.withColumn("score_distance", F.sqrt(F.aggregate(F.zip_with(scores, lam, lambda a, b: a * a / b), F.lit(0.0), lambda s, e: s + e))).withColumn("orthogonal_distance", F.sqrt(F.greatest(F.lit(0.0), total - inside)))
