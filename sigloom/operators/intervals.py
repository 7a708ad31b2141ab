"""Interval ("bounds") algebra: runs, containment and as-of joins, merging, splitting, painting.

Bounds are rows with a start and an end. Joins between points and bounds, or bounds and bounds, are bucketed equi-joins: each
interval is listed under the buckets of the axis that it covers, so Spark hashes on the bucket instead of comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: Sequence[str], order: str, same: Sequence[str] = ()) -> DataFrame:
    """Adds `island`: equal for rows of a group whose integer `order` is contiguous (and whose `same` columns agree)."""
    w = Window.partitionBy(*by, *same).orderBy(order)
    return df.withColumn("island", F.col(order) - F.row_number().over(w))


def runs(df: DataFrame, by: Sequence[str], order: str, flag: Column, *measures: Column) -> DataFrame:
    """Maximal runs of rows where flag holds: start, end and the measures' aggregates, per group."""
    kept = islands(df.filter(flag), by, order)
    return kept.groupBy(*by, "island").agg(F.min(order).alias("start"), F.max(order).alias("end"), *measures).drop("island")


def contiguous_groups(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Groups of contiguous integers: start, end and count."""
    return runs(df, by, order, F.lit(True), F.count("*").alias("n"))


def merge_close(bounds: DataFrame, by: Sequence[str], gap: float, *measures: Column) -> DataFrame:
    """Joins bounds whose gap to the one before is under `gap`; measures are aggregated over what is joined."""
    w = Window.partitionBy(*by).orderBy("start")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(F.col("start") - reach < gap, 0).otherwise(1)
    grouped = bounds.withColumn("_cut", cut).withColumn("grp", F.sum("_cut").over(w))
    return grouped.groupBy(*by, "grp").agg(F.min("start").alias("start"), F.max("end").alias("end"), *measures)


def filter_bounds(bounds: DataFrame, min_length=None, max_length=None, height: str | None = None, min_height=None, max_height=None) -> DataFrame:
    """Keeps bounds whose length (end - start + 1) and height lie within the limits, both inclusive."""
    length = F.col("end") - F.col("start") + 1
    for value, low, high in ((length, min_length, max_length), (F.col(height) if height else None, min_height, max_height)):
        if low is not None:
            bounds = bounds.filter(value >= low)
        if high is not None:
            bounds = bounds.filter(value <= high)
    return bounds


def covering(start: Column, end: Column, width: float) -> Column:
    """The numbers of the axis buckets that [start, end] touches."""
    return F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long"))


def points_in_bounds(points: DataFrame, bounds: DataFrame, at: str, width: float, keys: Sequence[str] = (), pick: str = "last", ident: str = "bound_id") -> DataFrame:
    """Left join of points to the closed bounds that hold them; of several the one with the largest (or, with pick="first",
    the smallest) ident counts, and 0 stands for none. Points keep all columns; ident must not be one of them.

    Each interval is listed once per bucket of `width`; the matches are reduced to one ident per point and bucket row before
    they meet the points again, in the same join.
    """
    listed = bounds.select(*keys, ident, F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(covering(F.col("start"), F.col("end"), width)).alias("_b"))
    # all intervals of a bucket as one array: the join then gives one row per point
    listed = listed.groupBy(*keys, "_b").agg(F.collect_list(F.struct(F.col(ident).alias("id"), "_s", "_e")).alias("_all"))
    out = points.withColumn("_b", F.floor(F.col(at) / width).cast("long")).join(listed, [*keys, "_b"], "left")
    hits = F.transform(F.filter("_all", lambda x: (x["_s"] <= F.col(at)) & (F.col(at) <= x["_e"])), lambda x: x["id"])
    best = F.array_max(hits) if pick == "last" else F.array_min(hits)
    return out.withColumn(ident, F.coalesce(best, F.lit(0))).drop("_b", "_all")


def bounds_in_bounds(small: DataFrame, big: DataFrame, width: float, keys: Sequence[str] = (), small_id: str = "small_id", big_id: str = "big_id") -> DataFrame:
    """Each small interval with the first big one (by start, end, id) that holds it strictly, or null.

    A big interval is listed under every bucket it covers, a small one under its start's, so they meet in one bucket.
    """
    listed = big.select(*keys, F.struct(F.col("start").alias("_s"), F.col("end").alias("_e"), F.col(big_id).alias("id")).alias("_big"), F.explode(covering(F.col("start"), F.col("end"), width)).alias("_b"))
    hit = small.withColumn("_b", F.floor(F.col("start") / width).cast("long")).join(listed, [*keys, "_b"], "left")
    inside = (F.col("start") > F.col("_big._s")) & (F.col("end") < F.col("_big._e"))
    return hit.groupBy(*keys, small_id, "start", "end").agg(F.min(F.when(inside, F.col("_big"))).alias("_best")).select(*keys, small_id, "start", "end", F.col("_best.id").alias(big_id))


def as_of(left: DataFrame, right: DataFrame, at: str, since: str, value: str, keys: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """The latest right row before (with strict=False: not after) each left row, as columns `since` and `value`; null if none.

    Both sides are put into one ordered stream per key, and a window carries the last right row forward: one shuffle on the
    keys, no pairs. Without keys the stream would be one task, so long axes should be given a key (a range) first.
    """
    kind = F.lit(0) if not strict else F.lit(2)
    lefts = left.withColumn("_t", F.col(at)).withColumn("_k", F.lit(1)).withColumn("_r", F.lit(None))
    rights = right.select(*keys, F.col(since).alias("_t"), kind.alias("_k"), F.struct(F.col(since), F.col(value)).alias("_r"))
    both = lefts.drop("_r").unionByName(rights, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).filter("_k = 1")
    return carried.select(*left.columns, F.col("_last")[since].alias(since), F.col("_last")[value].alias(value))


def put_bounds(bounds: DataFrame, length: int, value: str | None = None, order: str = "ord", default=0) -> DataFrame:
    """A signal of `length` samples (idx from 1) painted with the bounds, rounded and clamped; later bounds overwrite earlier ones.
    With value, painted samples have that column's value, else 1."""
    paint = F.col(value) if value else F.lit(1)
    painted = bounds.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).select(
        F.explode(F.sequence(F.greatest(F.round("start"), F.lit(1)).cast("long"), F.least(F.round("end"), F.lit(length)).cast("long"))).alias("idx"), paint.alias("v"), order
    )
    last = painted.groupBy("idx").agg(F.max_by("v", order).alias("v"))
    axis = bounds.sparkSession.range(1, length + 1).withColumnRenamed("id", "idx")
    return axis.join(last, "idx", "left").select("idx", F.coalesce("v", F.lit(default)).alias("value"))


def put_bounds_seconds(bounds: DataFrame, fs: float, length: int, value: str | None = None, order: str = "ord", default=0) -> DataFrame:
    """put_bounds of bounds in seconds from 0 at fs samples a second; an end's sample doesn't count any more."""
    samples = bounds.withColumn("start", F.round(F.col("start") * fs + 1)).withColumn("end", F.round(F.col("end") * fs + 1) - 1)
    return put_bounds(samples.filter(F.col("end") >= F.col("start")), length, value, order, default)


def holding(bounds: DataFrame, points: DataFrame, by: Sequence[str], at: str, least: int) -> DataFrame:
    """by, start, end, held of the different bounds that hold at least so many points, ends included.

    Points and both edges of the bounds stand on one axis per group; a bound holds the points counted up to its end less those counted
    before its start, so no bound meets its points.
    """
    edge = lambda c, k, sign: F.struct(F.col(c).cast("double").alias("x"), F.lit(k).alias("k"), F.lit(sign).alias("sign"))
    edges = bounds.select(*by, "start", "end").distinct().select(*by, "start", "end", F.explode(F.array(edge("start", -1, -1), edge("end", 1, 1))).alias("_e"))
    axis = points.select(*by, edge(at, 0, 0).alias("_e")).unionByName(edges, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy("_e.x", "_e.k").rowsBetween(Window.unboundedPreceding, 0)
    counted = axis.withColumn("_n", F.sum(F.when(F.col("_e.k") == 0, 1).otherwise(0)).over(order)).filter("_e.k <> 0")
    return counted.groupBy(*by, "start", "end").agg(F.sum(F.col("_n") * F.col("_e.sign")).alias("held")).filter(F.col("held") >= least)


def threshold_line(axis: DataFrame, points: DataFrame, by: Sequence[str], idx: str, at: str = "at", level: str = "level", out: str = "thr") -> DataFrame:
    """axis with the level of the line through its group's points (by, at, level), whose first and last levels go on to the ends.

    One window per group over both tables, in order: the last point before and the first one after each sample.
    """
    mark = F.struct(F.col(at).cast("double").alias("x"), F.col(level).cast("double").alias("y"))
    marks = points.select(*by, F.col(at).cast("double").alias("_x"), mark.alias("_m"), F.lit(0).alias("_k")).dropDuplicates([*by, "_x"])
    both = axis.withColumn("_x", F.col(idx).cast("double")).withColumn("_k", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    back = Window.partitionBy(*by).orderBy("_x", "_k").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.desc("_x"), "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_p", F.last("_m", ignorenulls=True).over(back)).withColumn("_n", F.last("_m", ignorenulls=True).over(ahead))
    p, n, x = F.col("_p"), F.col("_n"), F.col("_x")
    line = F.when(p["x"] == n["x"], p["y"]).otherwise(p["y"] + (x - p["x"]) * (n["y"] - p["y"]) / F.nullif(n["x"] - p["x"], F.lit(0.0)))
    found = F.when(p.isNull(), n["y"]).when(n.isNull(), p["y"]).otherwise(line)
    return both.withColumn(out, found).filter("_k = 1").select(*axis.columns, out)


def split_bounds(bounds: DataFrame, parts: int, skip: float = 0.0) -> DataFrame:
    """Each interval, less its first `skip`, in equal parts; intervals that are not longer than that give none."""
    span = (F.col("end") - F.col("start") - skip) / parts
    kept = bounds.filter(F.col("end") - F.col("start") > skip).withColumn("_span", span).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    begin = F.col("start") + skip + F.col("part") * F.col("_span")
    return kept.withColumn("part_start", begin).withColumn("part_end", begin + F.col("_span")).drop("_span")


def bound_stats(samples: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """min, max, mean, median, standard and robust deviation of the samples of each bound."""
    from sigloom.operators.stats import with_robust_std

    return with_robust_std(samples, by, value).select(*by, "min", "max", "mean", "median", "std", "robuststd")


def event_tags(*parts: tuple[DataFrame, str]) -> DataFrame:
    """(times, tag) tables put together, without rows that miss a time, in the order of their mean time: columns t0, t1, tag, pos."""
    out = None
    for df, tag in parts:
        one = df.select("t0", "t1", F.lit(tag).alias("tag")).filter(F.col("t0").isNotNull() & ~F.isnan("t0"))
        out = one if out is None else out.unionByName(one)
    mean = (F.col("t0") + F.coalesce("t1", "t0")) / 2
    return out.withColumn("mid", mean)
