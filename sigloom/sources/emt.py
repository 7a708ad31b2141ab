"""EMT text exports of motion and muscle recorders, parsed by column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, unit, tracks, frame, time, channel, value: one row per frame and channel. Blank files give none.

    Files are small texts, so each is read whole; its header line gives the channels' names.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    head = lambda p: F.regexp_extract("value", p, 1)
    files = files.withColumn("unit", head(r"(?m)^Measure unit:\s+(\w+)")).withColumn("tracks", head(r"(?m)^Tracks:\s+(\d+)").try_cast("int"))
    names = F.filter(F.split(F.regexp_extract("value", r"(?m)^\s+Frame\s+Time[ ]*\t+(.*?)\s*$", 1), r"\t"), lambda x: F.trim(x) != "")
    lines = files.select("path", "unit", "tracks", F.transform(names, lambda x: F.trim(x)).alias("names"), F.explode(F.split("value", r"\r?\n")).alias("line"))
    rows = lines.filter(F.col("line").rlike(r"^\s+\d+\s+\d+\.\d+(\s+-?\d+\.\d+)+\s*$")).withColumn("v", F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0))).filter(F.size("v") == F.col("tracks") + 2)
    out = rows.select("path", "unit", "tracks", F.col("v")[0].cast("long").alias("frame"), F.col("v")[1].cast("double").alias("time"), F.posexplode(F.arrays_zip("names", F.slice("v", 3, 10000).alias("x"))).alias("p", "z"))
    return out.select("path", "unit", "tracks", "frame", "time", F.col("z")["names"].alias("channel"), F.col("z")["x"].cast("double").alias("value"))


def muscle(rows: DataFrame) -> DataFrame:
    """Muscle recordings: millivolts as microvolts, fs from the median step of time, "EMG Signal 3" as emg3."""
    w = Window.partitionBy("path", "channel").orderBy("frame")
    steps = rows.withColumn("_d", F.col("time") - F.lag("time").over(w)).groupBy("path").agg(F.round(1 / F.median("_d")).alias("fs"))
    scaled = F.when(F.col("unit") == "mV", F.col("value") * 1000).otherwise(F.col("value"))
    return rows.join(steps, "path").withColumn("value", scaled).withColumn("unit", F.when(F.col("unit") == "mV", "uV").otherwise(F.col("unit"))).withColumn("channel", F.regexp_replace("channel", r"^EMG Signal (\d+).*$", "emg$1"))
