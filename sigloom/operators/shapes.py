"""Peaks, rectangles, clusters, sources and filters' images: kernels over one group's or one model's worth of numbers, and the
grouped maps that apply them."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def prominent_peaks(x: np.ndarray, min_height: float = -np.inf, min_prominence: float = 0.0, min_distance: int = 1) -> np.ndarray:
    """Indices of local maxima (a flat top counts once, at its start): high enough, standing out enough, the larger of close ones."""
    change = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    level = x[change]
    at = change[1:-1][(level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])] if len(level) > 2 else np.zeros(0, int)
    at = at[x[at] >= min_height]
    kept = []
    for i in at:
        left = np.flatnonzero(x[:i] > x[i])
        right = np.flatnonzero(x[i + 1 :] > x[i])
        low = max(x[(left[-1] if len(left) else 0) : i].min(), x[i + 1 : (i + 1 + right[0] + 1 if len(right) else len(x))].min())
        if x[i] - low >= min_prominence:
            kept.append(i)
    chosen: list[int] = []
    for i in sorted(kept, key=lambda i: (-x[i], i)):
        if all(abs(i - j) >= min_distance for j in chosen):
            chosen.append(i)
    return np.array(sorted(chosen), int)


def peaks_in_bounds(blocks: DataFrame, by: Sequence[str], bounds: DataFrame, fs: float, min_height: float, min_prominence: float, min_distance: int) -> DataFrame:
    """by, t (seconds from 0), height of the peaks that lie in a bound."""
    from sigloom.operators.intervals import points_in_bounds

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in part.iterrows():
            x = np.asarray(row["values"], float)
            out += [(*[row[c] for c in by], i / fs, float(x[i])) for i in prominent_peaks(x, min_height, min_prominence, min_distance)]
        return pd.DataFrame(out, columns=[*by, "t", "height"])

    kinds = dict(blocks.dtypes)
    found = blocks.mapInPandas(lambda parts: (run(p) for p in parts), ", ".join(f"{c} {kinds[c]}" for c in by) + ", t double, height double")
    return points_in_bounds(found, bounds, "t", 10.0).filter("bound_id <> 0")


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows: np.ndarray) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and np.cross(out[-1] - out[-2], q - out[-1]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return np.array(half(p) + half(p[::-1]))


def smallest_rectangle(points: np.ndarray) -> tuple[float, np.ndarray]:
    """Area and corners of the rectangle of least area around points: one of its sides lies along the hull."""
    h = hull(np.asarray(points, float))
    best = None
    for a, b in zip(h, np.roll(h, -1, 0)):
        d = (b - a) / (np.linalg.norm(b - a) or 1)
        turn = np.array([d, [-d[1], d[0]]])
        q = h @ turn.T
        lo, hi = q.min(0), q.max(0)
        area = float(np.prod(hi - lo))
        if best is None or area < best[0]:
            best = (area, np.array([lo, [hi[0], lo[1]], hi, [lo[0], hi[1]]]) @ turn)
    return best


def pixels_near(images: DataFrame, colours: Sequence[tuple[int, int, int]], tolerance: int) -> DataFrame:
    """path, row, col of pixels within the tolerance of any colour. images: path, height, width, data (rows of red, green, blue bytes)."""
    px = images.select("path", "width", F.posexplode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("_p", "k"), F.hex("data").alias("h"))
    byte = lambda c: F.conv(F.substring("h", F.col("k") * 6 + 1 + 2 * c, F.lit(2)), 16, 10).cast("int")
    near = None
    for colour in colours:
        one = None
        for c in range(3):
            ok = byte(c).between(colour[c] - tolerance, colour[c] + tolerance)
            one = ok if one is None else one & ok
        near = one if near is None else near | one
    return px.filter(near).select("path", F.floor(F.col("k") / F.col("width")).cast("int").alias("row"), (F.col("k") % F.col("width")).cast("int").alias("col"))


def clusters(points: DataFrame, x: str, y: str, k: int, rounds: int = 30, seed: int = 0) -> DataFrame:
    """points with cluster (from 0): k-means, each round one aggregation; centres start far from each other, on the rows themselves."""
    rows = points.groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).count()
    first = rows.orderBy(F.xxhash64("_x", "_y", F.lit(seed)), "_x", "_y").first()
    centres = [(float(first["_x"]), float(first["_y"]))]
    square = lambda c, a, b: (a - c[0]) * (a - c[0]) + (b - c[1]) * (b - c[1])
    while len(centres) < k:
        away = F.least(*[square(c, F.col("_x"), F.col("_y")) for c in centres]) if len(centres) > 1 else square(centres[0], F.col("_x"), F.col("_y"))
        far = rows.agg(F.max_by(F.struct("_x", "_y"), F.struct(away, "_x", "_y")).alias("p")).first()["p"]
        centres.append((float(far[0]), float(far[1])))

    def nearest(a: Column, b: Column) -> Column:
        d = F.array(*[square(c, a, b) for c in centres])
        return F.transform(F.array(d), lambda v: F.array_position(v, F.array_min(v)).cast("int") - 1)[0]

    for _ in range(rounds):
        got = {r["c"]: (r["a"], r["b"]) for r in rows.withColumn("c", nearest(F.col("_x"), F.col("_y"))).groupBy("c").agg((F.sum(F.col("_x") * F.col("count")) / F.sum("count")).alias("a"), (F.sum(F.col("_y") * F.col("count")) / F.sum("count")).alias("b")).collect()}
        new = [got.get(q, centres[q]) for q in range(k)]
        if new == centres:
            break
        centres = new
    return points.withColumn("cluster", nearest(F.col(x), F.col(y)))


def centroids(clustered: DataFrame, x: str, y: str) -> DataFrame:
    """Rounded medians per cluster, the largest y first."""
    return clustered.groupBy("cluster").agg(F.round(F.median(y)).alias("y"), F.round(F.median(x)).alias("x")).orderBy(F.desc("y"), "x")


def independent_components(white: np.ndarray, m: int | None = None, rounds: int = 400, seed: int = 0) -> np.ndarray:
    """Unmixing rows for whitened signals (channels x samples): the symmetric fixed point with the tanh nonlinearity."""
    n = white.shape[0]
    m = m or n
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0][:m]

    def apart(a: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(a, full_matrices=False)
        return u @ v

    for _ in range(rounds):
        y = np.tanh(w @ white)
        new = apart(y @ white.T / white.shape[1] - (1 - y * y).mean(1)[:, None] * w)
        if np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-10:
            return new
        w = new
    return w


def best_bin_size(samples: int, channels: int, trials: int) -> int:
    """The smallest bin that leaves fewer features than trials, then the largest with as many bins."""
    sizes = range(1, samples + 1)
    first = next((b for b in sizes if samples // b * channels < trials), samples)
    return max(b for b in sizes if samples // b == samples // first)


def compact_filter(filters: np.ndarray) -> np.ndarray:
    """One filter from several (columns): the signs under which their sum is longest, scaled to length 1."""
    signs = [(1, *s) for s in itertools.product((1, -1), repeat=filters.shape[1] - 1)]
    best = max((filters @ np.array(s) for s in signs), key=np.linalg.norm)
    return best / (np.linalg.norm(best) or 1)


def filter_image(filters: np.ndarray, spread: float = 0.0) -> np.ndarray:
    """Coefficients under mean + spread * deviation of the magnitudes as 0, signs aligned with the first column, the rest within +-1."""
    size = np.abs(filters)
    out = np.where(size >= size.mean() + spread * size.std(), filters, 0.0)
    out = out * np.where(out.T @ out[:, 0] < 0, -1, 1)
    return out / (np.abs(out).max() or 1)


def hex_of_double(x: Column) -> Column:
    """The little-endian bytes of a double in hexadecimal, for numbers that are zero or normal."""
    a = F.abs(x)
    e = F.floor(F.log2(a)).cast("int")
    e = F.when(a >= F.pow(F.lit(2.0), e + 1), e + 1).when(a < F.pow(F.lit(2.0), e), e - 1).otherwise(e)
    low = ((a / F.pow(F.lit(2.0), e) - 1) * float(1 << 52)).cast("long")
    bits = F.when(a == 0, F.lit(0).cast("long")).otherwise(F.shiftleft((e + 1023).cast("long"), 52) + low)
    top = F.when(x < 0, F.lit(-(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    big = F.lpad(F.hex(bits.bitwiseOR(top)), 16, "0")
    return F.concat(*[F.substring(big, 15 - 2 * k, 2) for k in range(8)])


def instance_number(cluster: Column, process: Column) -> Column:
    """Two numbers in base 36, one after the other."""
    return F.lower(F.concat(F.conv(cluster.cast("string"), 10, 36), F.conv(process.cast("string"), 10, 36)))


def ticks(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """n equally spaced numbers from low to high."""
    return spark.range(n).select((low + F.col("id") * (high - low) / max(1, n - 1)).alias("tick"))
