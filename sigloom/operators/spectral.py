"""Spectra and short recursions that stay in column expressions: discrete Fourier sums, biquad design and folding, cosine blocks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dft(df: DataFrame, by: Sequence[str], t: str, value: str, n: int) -> DataFrame:
    """re, im of bins k = 0 .. n/2 of the n samples t = 0 .. n-1 per group.

    Each sample is turned into its n/2+1 contributions, which are added up before the shuffle: one row per group and bin moves.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("k")
    angle = 2 * math.pi * F.col("k") * F.col(t) / n
    rows = df.filter((F.col(t) >= 0) & (F.col(t) < n)).select(*by, F.col(t), F.col(value), k)
    return rows.groupBy(*by, "k").agg(F.sum(F.col(value) * F.cos(angle)).alias("re"), (-F.sum(F.col(value) * F.sin(angle))).alias("im"))


def amplitude(df: DataFrame, by: Sequence[str], t: str, value: str, n: int) -> DataFrame:
    """Amplitude 2 |Y| / n and phase per bin."""
    return dft(df, by, t, value, n).select(*by, "k", (2 * F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / n).alias("amp"), F.atan2("im", "re").alias("phase"))


def band_power(df: DataFrame, by: Sequence[str], t: str, value: str, n: int, fs: float, bands: Sequence[tuple[float, float]]) -> DataFrame:
    """Power in half-open bands [lo, hi) from the Fourier sums; the mean's square goes to bands that begin at 0."""
    spectrum = dft(df, by, t, value, n)
    freq = F.col("k") * fs / n
    weight = F.when(F.col("k").isin(0, n // 2 if n % 2 == 0 else 0), 1.0).otherwise(2.0)
    power = weight * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (n * n)
    rows = spectrum.withColumn("band", F.explode(F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in bands])))
    return rows.filter((freq >= F.col("band.lo")) & (freq < F.col("band.hi"))).groupBy(*by, F.col("band.lo").alias("lo"), F.col("band.hi").alias("hi")).agg(F.sum(power).alias("power"))


def segment_power(df: DataFrame, by: Sequence[str], t: str, value: str, size: int) -> DataFrame:
    """Mean square per segment of `size` samples; a shorter one at the end is dropped."""
    seg = F.floor(F.col(t) / size).cast("long").alias("seg")
    return df.groupBy(*by, seg).agg(F.avg(F.col(value) * F.col(value)).alias("power"), F.count("*").alias("_n")).filter(F.col("_n") == size).drop("_n")


def biquad_design(fs: Column, low: Column, high: Column) -> Column:
    """The two sections of a fourth-order Butterworth band-pass: array of struct (scale, a1, a2); numerators are scale * [1, 0, -1].

    The analogue second-order prototype's pole p at 135 degrees is sent through the low-to-band-pass map, s^2 - p B s + w^2 = 0, whose
    two roots (with their conjugates) are the sections; the bilinear map then gives the digital coefficients.
    """
    warp = lambda f: F.tan(math.pi * f / fs)
    w1, w2 = warp(low), warp(high)
    width, centre2 = w2 - w1, w1 * w2
    # p = (-1 + i) / sqrt(2); discriminant (p B)^2 - 4 w^2 = -i B^2 - 4 w^2, whose square root is taken in polar form
    re, im = -4 * centre2, -(width * width)
    size, half = F.pow(re * re + im * im, F.lit(0.25)), F.atan2(im, re) / 2
    dr, di = size * F.cos(half), size * F.sin(half)
    pr, pi = -width / math.sqrt(2), width / math.sqrt(2)

    def section(sign: int) -> Column:
        sr, si = (pr + sign * dr) / 2, (pi + sign * di) / 2
        norm = sr * sr + si * si
        a0 = 1 - 2 * sr + norm
        return F.struct((width / a0).alias("scale"), (2 * (norm - 1) / a0).alias("a1"), ((1 + 2 * sr + norm) / a0).alias("a2"))

    return F.array(section(1), section(-1))


def biquad_fold(values: Column, scale: Column, a1: Column, a2: Column) -> Column:
    """One section run over an array from rest (transposed direct form II); for arrays of a few thousand samples at most."""
    start = F.struct(F.lit(0.0).alias("z1"), F.lit(0.0).alias("z2"), F.array().cast("array<double>").alias("y"))

    def step(s: Column, x: Column) -> Column:
        y = scale * x + s["z1"]
        return F.struct((s["z2"] - a1 * y).alias("z1"), (-scale * x - a2 * y).alias("z2"), F.concat(s["y"], F.array(y)).alias("y"))

    return F.aggregate(values, start, step, lambda s: s["y"])


def dct8(block: Column) -> Column:
    """The scaled cosine transform (orthonormal) of an array of eight."""
    return F.array(*[math.sqrt((1 if k == 0 else 2) / 8) * sum(block[i] * math.cos(math.pi * (2 * i + 1) * k / 16) for i in range(8)) for k in range(8)])


def idct8(block: Column) -> Column:
    return F.array(*[sum(block[k] * math.sqrt((1 if k == 0 else 2) / 8) * math.cos(math.pi * (2 * i + 1) * k / 16) for k in range(8)) for i in range(8)])
