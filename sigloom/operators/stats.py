"""Windowed and grouped statistics of sampled signals. Missing samples are SQL nulls."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Makes the median absolute deviation of normal samples equal their standard deviation.
MAD_SCALE = 1.4826


def with_robust_std(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group: n, min, max, mean, median, std, mad, robuststd. Two aggregations: the medians, then the deviations from them.

    Medians are exact, so a group's distinct values meet in one task (as counts, not rows).
    """
    first = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"))
    off = df.join(first.select(*by, "median"), list(by)).groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return first.join(off, list(by)).withColumn("robuststd", F.col("mad") * MAD_SCALE)


def median(df: DataFrame, value: Column, within: tuple[float, float] | None = None, bins: int = 4096, few: int = 20_000) -> float | None:
    """The exact median of the finite numbers of a whole table, however many of them differ.

    A pass counts the values per bin of a range, with each bin's least and largest; the bin in which the middle lies is the next range,
    until it holds one value, or so few that they are fetched. So a pass leaves bins + 2 rows, and no task or driver gets all values. Bins
    follow the values' order and a range of two values is always split, hence it ends. within: where the median may lie; a guess that
    holds saves passes, one that doesn't costs some.
    """
    v = df.select(value.cast("double").alias("v")).filter(F.abs(F.col("v")) < float("inf"))
    low, high = within or (0.0, 0.0)
    below, ranks = 0, None
    while True:
        half = 0.5 if math.isinf(high - low) else 1.0
        place = F.floor((F.col("v") * half - low * half) / (high * half - low * half) * bins) if high > low else F.lit(bins - 1)
        place = F.when(F.col("v") < low, -1).when(F.col("v") > high, bins).otherwise(F.least(place, F.lit(bins - 1))).cast("int")
        # outside a later range there is nothing that is wanted
        rows = (v if ranks is None else v.filter(F.col("v").between(low, high))).groupBy(place.alias("p")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        rows.sort(key=lambda r: r["p"])
        if ranks is None:
            n = sum(r["n"] for r in rows)
            if not n:
                return None
            ranks = ((n - 1) // 2, n // 2)
        at = 0
        while below + rows[at]["n"] <= ranks[0]:
            below += rows[at]["n"]
            at += 1
        n, low, high = rows[at]["n"], rows[at]["low"], rows[at]["high"]
        if below + n <= ranks[1]:  # the middle two are this bin's last and the next one's first
            return high / 2 + rows[at + 1]["low"] / 2
        if low == high:
            return low
        if n <= few:
            values = sorted(r["v"] for r in v.filter(F.col("v").between(low, high)).collect())
            return values[ranks[0] - below] / 2 + values[ranks[1] - below] / 2


def sem(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Deviations over the number of samples: sem and robustsem. (Over n, not its root: the convention of the source data.)"""
    return with_robust_std(df, by, value).select(*by, (F.col("std") / F.col("n")).alias("sem"), (F.col("robuststd") / F.col("n")).alias("robustsem"))


def zscore(df: DataFrame, by: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """(value - mean) / sample deviation per group, nulls left out of both."""
    w = Window.partitionBy(*by)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.stddev_samp(value).over(w))


def common_average(df: DataFrame, time: Sequence[str], channel: str, value: str, out: str = "referenced") -> DataFrame:
    """Subtracts each time's mean over the channels that vary; flat channels stay as they are and don't count.

    Whether a channel varies comes from one aggregation, joined back: there are few channels, however long the signal.
    """
    varies = df.groupBy(channel).agg((F.coalesce(F.stddev_samp(value), F.lit(0.0)) > 0).alias("_varies"))
    live = df.join(varies, channel).withColumn("_live", F.when(F.col("_varies"), F.col(value)))
    mean = F.avg("_live").over(Window.partitionBy(*time))
    return live.withColumn(out, F.when(F.col("_varies"), F.col(value) - mean).otherwise(F.col(value))).drop("_varies", "_live")


def detrend(df: DataFrame, by: Sequence[str], x: str, y: str, out: str = "detrended", linear: bool = True) -> DataFrame:
    """Subtracts the least-squares line (or the mean) of each group."""
    if not linear:
        return df.withColumn(out, F.col(y) - F.avg(y).over(Window.partitionBy(*by)))
    fit = df.groupBy(*by).agg(F.regr_slope(y, x).alias("_a"), F.regr_intercept(y, x).alias("_b"))
    return df.join(fit, list(by)).withColumn(out, F.col(y) - F.col("_a") * F.col(x) - F.col("_b")).drop("_a", "_b")


def bin_mean(df: DataFrame, by: Sequence[str], idx: str, value: str, size: int) -> DataFrame:
    """Means of non-overlapping bins of `size` samples (idx from 1); a shorter bin at the end is dropped."""
    number = F.floor((F.col(idx) - 1) / size).cast("long")
    return df.groupBy(*by, number.alias("bin")).agg(F.avg(value).alias("mean"), F.count("*").alias("_n")).filter(F.col("_n") == size).drop("_n")


def moving_average(df: DataFrame, by: Sequence[str], idx: str, value: str, span: int, out: str = "smooth") -> DataFrame:
    """Centred moving average over an odd span within runs without nulls; near a run's ends the window shrinks on both sides alike.

    From running sums: a window's sum is the difference of two of them, so the cost doesn't depend on the span.
    """
    half = (span - 1) // 2 if span % 2 else span // 2 - 1
    run = Window.partitionBy(*by).orderBy(idx)
    tagged = df.withColumn("_run", F.sum(F.col(value).isNull().cast("int")).over(run))
    mine = Window.partitionBy(*by, "_run", F.col(value).isNull()).orderBy(idx)
    whole = mine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pos, n = F.row_number().over(mine), F.count("*").over(whole)
    w = tagged.withColumn("_k", F.least(pos - 1, n - pos, F.lit(half)))
    out_ = None
    for k in range(half + 1):  # one frame per possible half width; all share one sort
        mean = F.avg(value).over(mine.rowsBetween(-k, k))
        out_ = F.when(F.col("_k") == k, mean) if out_ is None else out_.when(F.col("_k") == k, mean)
    return w.withColumn(out, F.when(F.col(value).isNotNull(), out_)).drop("_run", "_k")


def bridge_nulls(df: DataFrame, by: Sequence[str], idx: str, value: str, out: str = "bridged", extrapolate: bool = True) -> DataFrame:
    """Linear interpolation over missing samples; at the ends the line through the two nearest known samples goes on, or nulls stay."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(idx).cast("double").alias("x"), F.col(value).cast("double").alias("y")))
    back = Window.partitionBy(*by).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    # the next known sample is the last one seen from the other end: a frame that grows, not one that is gone through again for every row
    ahead = Window.partitionBy(*by).orderBy(F.desc(idx)).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_known", known).withColumn("_p", F.last("_known", ignorenulls=True).over(back)).withColumn("_n", F.last("_known", ignorenulls=True).over(ahead))
    line = lambda a, b: a["y"] + (F.col(idx) - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"])
    p, n = F.col("_p"), F.col("_n")
    filled = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(p.isNotNull() & n.isNotNull(), line(p, n))
    if extrapolate:
        ends = two_ends(df, by)
        df = df.join(ends, list(by), "left")
        h1, h2, t1, t2 = F.col("_h1"), F.col("_h2"), F.col("_t1"), F.col("_t2")
        filled = filled.when(p.isNull() & h2.isNotNull(), line(h1, h2)).when(n.isNull() & t2.isNotNull(), line(t2, t1))
        return df.withColumn(out, filled).drop("_known", "_p", "_n", "_h1", "_h2", "_t1", "_t2")
    return df.withColumn(out, filled).drop("_known", "_p", "_n")


def two_ends(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The first two and the last two known samples of each group, from two small ranked passes over `_known`."""
    known = df.filter(F.col("_known").isNotNull()).select(*by, "_known")
    rank = lambda order: F.row_number().over(Window.partitionBy(*by).orderBy(order))
    up = known.withColumn("_r", rank(F.col("_known.x"))).filter("_r <= 2").groupBy(*by).agg(F.max(F.when(F.col("_r") == 1, F.col("_known"))).alias("_h1"), F.max(F.when(F.col("_r") == 2, F.col("_known"))).alias("_h2"))
    down = known.withColumn("_r", rank(F.desc("_known.x"))).filter("_r <= 2").groupBy(*by).agg(F.max(F.when(F.col("_r") == 1, F.col("_known"))).alias("_t1"), F.max(F.when(F.col("_r") == 2, F.col("_known"))).alias("_t2"))
    return up.join(down, list(by))


def equalised(df: DataFrame, by: Sequence[str], reference: str, value: str, out: str = "equalised") -> DataFrame:
    """value brought to the level and spread (medians and median deviations) of reference, per group."""
    a = with_robust_std(df, by, reference).select(*by, F.col("median").alias("_m1"), F.col("mad").alias("_d1"))
    b = with_robust_std(df, by, value).select(*by, F.col("median").alias("_m2"), F.col("mad").alias("_d2"))
    both = df.join(a.join(b, list(by)), list(by))
    return both.withColumn(out, (F.col(value) - F.col("_m2")) * F.col("_d1") / F.col("_d2") + F.col("_m1")).drop("_m1", "_m2", "_d1", "_d2")


def peak_to_peak(df: DataFrame, by: Sequence[str], idx: str, value: str, n: int, out: str = "p2p") -> DataFrame:
    """max - min of the last n samples."""
    w = Window.partitionBy(*by).orderBy(idx).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.max(value).over(w) - F.min(value).over(w))


def local_peaks(df: DataFrame, by: Sequence[str], idx: str, value: str, min_height: float | None = None) -> DataFrame:
    """Samples above both neighbours (and not under min_height); the first and last sample of a group are none."""
    w = Window.partitionBy(*by).orderBy(idx)
    out = df.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).filter((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b")))
    return (out if min_height is None else out.filter(F.col(value) >= min_height)).drop("_a", "_b")


def histogram(df: DataFrame, by: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins of [low, high); values outside are left out."""
    number = F.floor((F.col(value) - low) / ((high - low) / bins)).cast("long")
    return df.withColumn("bin", number).filter(F.col("bin").between(0, bins - 1)).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """The chance of k or more of n successes, by sums of logarithms."""
    log_factorial = lambda m: F.aggregate(F.when(m >= 2, F.sequence(F.lit(2), m)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    term = lambda i: F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) + i * F.log(p) + (n - i) * F.log(1 - p))
    return F.aggregate(F.sequence(F.ceil(k).cast("int"), n), F.lit(0.0), lambda a, i: a + term(i))
