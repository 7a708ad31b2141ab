"""Action detection: a threshold from a sweep over levels, and the bounds of what exceeds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators import intervals


def level_counts(df: DataFrame, by: Sequence[str], idx: str, value: str, levels: int = 201) -> DataFrame:
    """How many times each channel rises over each of `levels` equal levels between its extremes.

    No sample is tried against every level. A sample at v after one at u rises over exactly the levels in (from u's, to v's]:
    the first of them gets +1 and the one past the last -1, and running sums over the levels give the counts. So the work is
    one row per sample, and the window runs over `levels` rows per channel.
    """
    ends = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    s = df.join(F.broadcast(ends) if not by else ends, list(by)) if by else df.crossJoin(F.broadcast(ends))
    step = (F.col("hi") - F.col("lo")) / (levels - 1)
    # the number of levels under the sample: the smallest l with lo + step * l >= v, put right where rounding has missed
    guess = F.least(F.lit(levels - 1), F.greatest(F.lit(0), F.ceil((F.col(value) - F.col("lo")) / step))).cast("int")
    level = lambda l: F.col("lo") + (F.col("hi") - F.col("lo")) * l / (levels - 1)
    under = F.when(F.col("hi") <= F.col("lo"), 0).when((guess > 0) & (level(guess - 1) >= F.col(value)), guess - 1).when(level(guess) < F.col(value), guess + 1).otherwise(guess)
    s = s.withColumn("_u", under).withColumn("_p", F.lag("_u", 1, 0).over(Window.partitionBy(*by).orderBy(idx)))
    rise = s.filter("_u > _p").select(*by, F.explode(F.array(F.struct(F.col("_p").alias("l"), F.lit(1).alias("d")), F.struct(F.col("_u").alias("l"), F.lit(-1).alias("d")))).alias("e"))
    steps = rise.groupBy(*by, F.col("e.l").alias("l")).agg(F.sum("e.d").alias("d"))
    axis = ends.select(*by, F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("l"))
    full = axis.join(steps, [*by, "l"], "left")
    return full.withColumn("n", F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy(*by).orderBy("l"))).drop("d")


def plateau(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The longest stretch of levels over which the count changes by no more than its mean change: a, z (the first of equals)."""
    w = Window.partitionBy(*by).orderBy("l")
    d = counts.withColumn("d", F.abs(F.col("n") - F.lag("n", 1).over(w))).withColumn("d", F.coalesce("d", F.lit(0)))
    d = d.withColumn("tol", F.avg(F.col("d").cast("double")).over(Window.partitionBy(*by)))
    found = intervals.runs(d, by, "l", F.col("d") <= F.col("tol"))
    best = Window.partitionBy(*by).orderBy(F.desc(F.col("end") - F.col("start")), "start")
    return found.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(*by, F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("z"))


def detected(df: DataFrame, by: Sequence[str], idx: str, value: str, at: float = 0.5, levels: int = 201, merge: float = 0, min_length=None, max_length=None, min_height=None, max_height=None) -> DataFrame:
    """Bounds of the runs over the threshold at fraction `at` of the plateau: filtered by length and height first, then merged."""
    stretch = plateau(level_counts(df, by, idx, value, levels), by)
    ends = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    thr = stretch.join(ends, list(by)).select(*by, (F.col("lo") + (F.col("hi") - F.col("lo")) * F.round(F.col("a") + (F.col("z") - F.col("a")) * at) / (levels - 1)).alias("thr"))
    over = df.join(thr, list(by))
    found = intervals.runs(over, by, idx, F.col(value) > F.col("thr"), F.max(value).alias("peak"))
    kept = intervals.filter_bounds(found, min_length, max_length, "peak", min_height, max_height)
    return intervals.merge_close(kept, by, merge, F.max("peak").alias("peak")) if merge else kept


def duration_summary(bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Medians and 1.4826 times the median deviations of durations and of the gaps between onsets."""
    from sigloom.operators.stats import with_robust_std

    w = Window.partitionBy(*by).orderBy("start")
    rows = bounds.withColumn("duration", (F.col("end") - F.col("start") + 1).cast("double")).withColumn("gap", (F.col("start") - F.lag("start").over(w)).cast("double"))
    a = with_robust_std(rows, by, "duration").select(*by, F.col("median").alias("duration_median"), F.col("robuststd").alias("duration_dev"))
    b = with_robust_std(rows.filter("gap is not null"), by, "gap").select(*by, F.col("median").alias("gap_median"), F.col("robuststd").alias("gap_dev"))
    return a.join(b, list(by), "left")
