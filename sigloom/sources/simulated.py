"""Simulated recordings: sines at the frequency a channel's name tells, with noise that a seed decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READY = 2


def signal(channel: Column, n: Column, fs: float, seed: int = 1) -> Column:
    """The sample of "10Hz", "10HzN3" (with mains noise ten to the third), "10HzSquare" and the like at sample number n."""
    hz = F.regexp_extract(channel, r"^(\d+)Hz", 1).try_cast("double")
    level = F.regexp_extract(channel, r"N(\d)$", 1).try_cast("int")
    noise = (F.pmod(F.xxhash64(channel, n, F.lit(seed)), F.lit(1 << 32)) / float(1 << 31)) - 1
    phase = 2 * math.pi * hz * n / fs
    wave = F.when(channel.contains("Square"), F.signum(F.sin(phase))).otherwise(F.sin(phase))
    mains = F.when(level.isNotNull(), F.pow(F.lit(10.0), level) * 1e-3 * F.sin(2 * math.pi * 60 * n / fs)).otherwise(0.0)
    return F.coalesce(wave, F.lit(0.0)) * (1 + 0.01 * noise) + mains


def batch(spark: SparkSession, channels: list[str], fs: float, seconds: float, seed: int = 1) -> DataFrame:
    """sample_no, status, diag, channel, value."""
    rows = spark.range(int(fs * seconds)).withColumnRenamed("id", "sample_no").withColumn("channel", F.explode(F.array(*map(F.lit, channels))))
    return shaped(rows, fs, seed)


def stream(spark: SparkSession, channels: list[str], fs: int, seed: int = 1) -> DataFrame:
    """The same as an endless stream, fs samples a second."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", fs).load().withColumn("sample_no", F.col("value")).drop("value")
    return shaped(rows.withColumn("channel", F.explode(F.array(*map(F.lit, channels)))), fs, seed)


def shaped(rows: DataFrame, fs: float, seed: int) -> DataFrame:
    return rows.withColumn("status", F.lit(READY)).withColumn("diag", F.col("sample_no") % 64).withColumn("value", signal(F.col("channel"), F.col("sample_no"), fs, seed))


def mixture(spark: SparkSession, n: int = 500) -> DataFrame:
    """Four unit-variance, zero-mean sources (sine, cubed saw, saw, impulses by hash) for component analysis: t, source, value."""
    t = F.col("id")
    saw = F.pmod(t, F.lit(23)) - 11
    parts = [F.sin(t / 2.0), F.pow(saw / 9.0, F.lit(5.0)), F.pmod(t, F.lit(27)) - 13.0, F.when(F.pmod(F.xxhash64(t), F.lit(10)) == 0, 3.0).otherwise(0.0) * F.signum(F.xxhash64(t, F.lit(1)).cast("double"))]
    rows = spark.range(n).select("id", F.posexplode(F.array(*[p.cast("double") for p in parts])).alias("source", "v"))
    m = rows.groupBy("source").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    return rows.join(F.broadcast(m), "source").select(F.col("id").alias("t"), "source", ((F.col("v") - F.col("_m")) / F.col("_s")).alias("value"))
