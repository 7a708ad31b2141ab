"""Regression from aggregated normal equations, robust refits, and surrogate significance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators.stats import median


def moments(df: DataFrame, xs: Sequence[str], ys: Sequence[str], affine: bool = True, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """X'X, X'Y, Y'Y (diagonal) and the weight of all finite rows: one aggregation."""
    x = [F.col(c).cast("double") for c in xs] + ([F.lit(1.0)] if affine else [])
    y = [F.col(c).cast("double") for c in ys]
    w = F.col(weight) if weight else F.lit(1.0)
    ok = None
    for c in [*xs, *ys]:
        one = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
        ok = one if ok is None else ok & one
    p, q = len(x), len(y)
    sums = [F.sum(w * x[i] * x[j]) for i in range(p) for j in range(i, p)] + [F.sum(w * x[i] * y[j]) for i in range(p) for j in range(q)] + [F.sum(w * v * v) for v in y] + [F.sum(w)]
    row = [v or 0.0 for v in df.filter(ok).agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()]
    xx = np.zeros((p, p))
    xx[np.triu_indices(p)] = row[: p * (p + 1) // 2]
    xx = xx + np.triu(xx, 1).T
    at = p * (p + 1) // 2
    return xx, np.array(row[at : at + p * q]).reshape(p, q), np.array(row[at + p * q : -1]), row[-1]


def least_squares(df: DataFrame, xs: Sequence[str], ys: Sequence[str], affine: bool = True) -> np.ndarray:
    """Coefficients (predictors, then the constant) per target."""
    xx, xy, _, _ = moments(df, xs, ys, affine)
    return np.linalg.pinv(xx) @ xy


def fitted_column(xs: Sequence[str], b: np.ndarray, affine: bool = True):
    out = F.lit(float(b[-1]) if affine else 0.0)
    for c, k in zip(xs, b):
        out = out + float(k) * F.col(c)
    return out


def leave_one_out(df: DataFrame, xs: Sequence[str], y: str, affine: bool = True, out: str = "loo") -> DataFrame:
    """Adds each row's prediction by the fit without it: from its residual and leverage, so there is one fit in all."""
    xx, xy, _, _ = moments(df, xs, [y], affine)
    inverse = np.linalg.pinv(xx)
    b = (inverse @ xy)[:, 0]
    row = F.array(*[F.col(c).cast("double") for c in xs], *([F.lit(1.0)] if affine else []))
    dot = lambda a, c: F.aggregate(F.zip_with(a, c, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    lever = dot(row, F.transform(F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in inverse]), lambda r: dot(row, r)))
    return df.withColumn(out, F.col(y) - (F.col(y) - fitted_column(xs, b, affine)) / (1 - lever))


def robust(df: DataFrame, xs: Sequence[str], y: str, affine: bool = True, rounds: int = 20, tune: float = 4.685) -> np.ndarray:
    """Bisquare weights refitted until the coefficients stand still, on all rows whose numbers are finite. Each round is an exact median,
    found by counting, and an aggregation; rows never leave the executors, which keep these columns alone meanwhile."""
    kept = df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*xs, y])])
    for c in kept.columns:
        kept = kept.filter(F.abs(F.col(c)) < float("inf"))
    kept = kept.persist()
    try:
        xx, xy, yy, n = moments(kept, xs, [y], affine)
        b = (np.linalg.pinv(xx) @ xy)[:, 0]
        # half of the residuals are under the root of twice their mean square
        within, last = (0.0, 1.42 * float(np.sqrt(max(0.0, yy[0] - b @ xy[:, 0]) / max(n, 1.0)))), None
        for _ in range(rounds):
            r = F.col(y) - fitted_column(xs, b, affine)
            middle = median(kept, F.abs(r), within)
            if not middle:
                break
            off = 0.1 * middle if last is None else 2 * abs(middle - last)
            within, last = (middle - off, middle + off), middle
            u = r / (tune * middle / 0.6745)
            weighted = kept.withColumn("_w", F.when(F.abs(u) < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0))
            xx, xy, _, _ = moments(weighted, xs, [y], affine, "_w")
            new = np.linalg.pinv(xx) @ xy[:, 0]
            done = np.abs(new - b).max() <= 1e-8 * max(1.0, np.abs(b).max())
            b = new
            if done:
                break
        return b
    finally:
        kept.unpersist()


def determination(df: DataFrame, xs: Sequence[str], y: str, b: np.ndarray, affine: bool = True) -> tuple[float, float]:
    """Squared correlation of fit and target, and the same adjusted for the number of predictors."""
    r, n = df.withColumn("_f", fitted_column(xs, b, affine)).agg(F.corr("_f", y), F.count(y)).first()
    cod = (r or 0.0) ** 2
    return cod, 1 - (1 - cod) * (n - 1) / max(1, n - len(xs) - 1)


def nonlinear(model: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray, start: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Levenberg-Marquardt with bisquare weights on a sample that fits one task."""
    b, lam = np.array(start, float), 1e-2

    def weights(r: np.ndarray) -> np.ndarray:
        u = r / (4.685 * (np.median(np.abs(r)) / 0.6745 or 1.0))
        return np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0)

    for _ in range(rounds):
        r = y - model(b, x)
        w = weights(r)
        jac = np.stack([(model(b + h, x) - model(b - h, x)) / (2 * h.max()) for h in np.diag(1e-6 * np.maximum(1, np.abs(b)))], 1)
        a, g = jac.T @ (w[:, None] * jac), jac.T @ (w * r)
        step = np.linalg.pinv(a + lam * np.diag(np.diag(a))) @ g
        if (w * (y - model(b + step, x)) ** 2).sum() < (w * r * r).sum():
            b, lam = b + step, lam / 3
            if np.abs(step).max() < 1e-10:
                break
        else:
            lam *= 4
    return b


def surrogate_r2(spark: SparkSession, x: np.ndarray, y: np.ndarray, draws: int = 1000, method: int = 2, seed: int = 11) -> DataFrame:
    """R squared of regressions of y on random stand-ins of x, one row per draw: 0 uniform, 1 with x's covariance, 2 also with its
    first-order autoregression. Draws are dealt over the tasks; each is seeded by its own number."""
    xs = np.asarray(x, float) - np.mean(x, 0)
    n, p = xs.shape
    chol = np.linalg.cholesky(np.cov(xs.T).reshape(p, p) + 1e-12 * np.eye(p))
    phi = np.linalg.lstsq(xs[:-1], xs[1:], rcond=None)[0]
    noise = np.linalg.cholesky(np.cov((xs[1:] - xs[:-1] @ phi).T).reshape(p, p) + 1e-12 * np.eye(p))
    t = np.asarray(y, float) - np.mean(y)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k in part["id"]:
                rng = np.random.default_rng([seed, int(k)])
                if method == 0:
                    s = rng.uniform(size=(n, p))
                else:
                    s = rng.normal(size=(n, p)) @ (chol if method == 1 else noise).T
                    if method == 2:
                        for i in range(1, n):
                            s[i] += s[i - 1] @ phi
                s = s - s.mean(0)
                f = s @ np.linalg.lstsq(s, t, rcond=None)[0]
                out.append((int(k), float((f @ t) ** 2 / ((f @ f) * (t @ t) or 1))))
            yield pd.DataFrame(out, columns=["draw", "r2"])

    return spark.range(draws).mapInPandas(run, "draw long, r2 double")


def significance(draws: DataFrame, p: float) -> float:
    """The R squared that a share p of the draws exceeds."""
    n = draws.count()
    k = int(np.floor(p * n))
    return draws.orderBy(F.desc("r2")).limit(max(1, k)).agg(F.min("r2")).first()[0]
