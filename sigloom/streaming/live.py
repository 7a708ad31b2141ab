"""Live acquisition as Structured Streaming: stateless steps on any stream, and filters that carry their state per channel.

All stateless functions work on batches as well, which is how their results are checked.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigloom.operators import dsp

# fixed values: bits of an amplifier's status
READY, TRIGGER, BATTERY_LOW = 2, 4, 64


def valid(samples: DataFrame) -> DataFrame:
    """Samples that the amplifier sent (status over 0)."""
    return samples.filter("status > 0")


def status_bits(samples: DataFrame) -> DataFrame:
    bit = lambda b: F.col("status").bitwiseAND(F.lit(b)) > 0
    return samples.withColumn("ready", bit(READY)).withColumn("trigger", bit(TRIGGER)).withColumn("battery_low", bit(BATTERY_LOW))


def referenced(row: Column) -> Column:
    """An array of channels less its mean."""
    mean = F.aggregate(row, F.lit(0.0), lambda a, v: a + v) / F.size(row)
    return F.transform(F.array(mean), lambda m: F.transform(row, lambda v: v - m))[0]


def scaled(samples: DataFrame, factors: DataFrame, by: str = "channel", value: str = "value", out: str = "volts") -> DataFrame:
    """Raw counts times their channel's factor. factors: channel, factor; one row a channel, so a small side of the join."""
    return samples.join(factors, by).withColumn(out, F.col(value) * F.col("factor")).drop("factor")


def centred(samples: DataFrame, window: list[str], value: str = "value", spread: bool = False, out: str = "centred") -> DataFrame:
    """Samples less the median of their display window (columns of `window`), or, with spread, as standard scores in it."""
    v = F.col(value).cast("double")
    level = samples.groupBy(*window).agg(*([F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s")] if spread else [F.median(v).alias("_m")]))
    scored = (v - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0)) if spread else v - F.col("_m")
    return samples.join(level, list(window)).withColumn(out, scored).drop("_m", "_s")


def gaps(triggers: DataFrame, by: list[str], at: str, warn: float, stop: float | None = None) -> DataFrame:
    """Times between a source's triggers over `warn` seconds: by, since, until, seconds, and whether they'd have stopped the recording."""
    w = Window.partitionBy(*by).orderBy(at)
    since = F.lag(at).over(w)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1000000 - F.unix_micros(F.col("since").cast("timestamp")) / 1000000
    out = triggers.select(*by, F.col(at).alias("until"), since.alias("since")).withColumn(at, F.col("until")).withColumn("seconds", seconds).drop(at)
    return out.filter(F.col("seconds") > warn).withColumn("stopped", F.lit(False) if stop is None else F.col("seconds") > stop)


def over_voltage(p2p: DataFrame, level: float, sane: float | None = None) -> DataFrame:
    """p2p (channel, p2p, changes) with state: stuck, normal, over, or (from `sane` on) failed."""
    state = F.when(~F.col("changes"), "stuck")
    if sane is not None:
        state = state.when(F.abs("p2p") >= sane, "failed")
    return p2p.withColumn("state", state.when(F.abs("p2p") < level, "normal").otherwise("over"))


def normal_score(states: DataFrame, by: list[str]) -> DataFrame:
    """How many channels are normal, less 0.8 of all channels for each that is over."""
    n = F.count("*")
    return states.groupBy(*by).agg((F.count_if(F.col("state") == "normal") - F.count_if(F.col("state") == "over") * n * 0.8).alias("score"))


def ring(samples: DataFrame, by: list[str], idx: str, size: int) -> DataFrame:
    """The samples that a ring of `size` places holds after the last one, with their place (from 0) and age (0: the newest)."""
    last = samples.groupBy(*by).agg(F.max(idx).alias("_z"))
    held = samples.join(last, list(by)).filter(F.col(idx) > F.col("_z") - size)
    return held.withColumn("place", F.pmod(F.col(idx) - 1, F.lit(size))).withColumn("age", F.col("_z") - F.col(idx)).drop("_z")


def packet_loss(samples: DataFrame, by: list[str], order: str, wide: bool = True) -> DataFrame:
    """Lost, received and the share lost, from the jumps of the diagnostic counter: in wide frames a step other than 1 is a loss,
    in narrow ones (counter by 2, modulo 64) the missing steps are counted."""
    w = Window.partitionBy(*by).orderBy(order)
    d = samples.withColumn("_d", F.col("diag") - F.lag("diag").over(w))
    lost = F.when(~F.col("_d").isin(1, -63), 1).otherwise(0) if wide else F.when(~F.col("_d").isin(2, -62), (F.pmod(F.col("_d"), F.lit(64)) - 2) / 2).otherwise(0)
    return d.groupBy(*by).agg(F.sum(F.when(F.col("_d").isNull(), 0).otherwise(lost)).alias("lost"), F.count("*").alias("n")).withColumn("share", F.col("lost") / F.col("n"))


def stuck(p2p: DataFrame, by: list[str], order: str, n: int = 8) -> DataFrame:
    """Channels whose peak-to-peak values haven't changed over the last n readings, though the signal isn't flat."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    last = p2p.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return last.groupBy(*by).agg(((F.count("*") == n) & (F.min("p2p") == F.max("p2p")) & (F.max("p2p") > 0)).alias("stuck"), (F.max("p2p") < 1.4e-3).alias("normal"))


def tumbling(events: DataFrame, ts: str, width: str, by: list[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Count, mean, extremes and their distance per event-time window; late data is waited for as long as `late` says."""
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width, slide), *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"), (F.max("value") - F.min("value")).alias("p2p"))


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def filtered(samples: DataFrame, sos: np.ndarray, envelope: np.ndarray | None = None) -> DataFrame:
    """channel, sample_no, filtered, envelope of a stream (channel, sample_no, status, value): recursive filters whose state is kept per
    channel from batch to batch; samples with status 0 are dropped, and a batch's samples are put in order first.

    The envelope is the square through a second filter. The result equals the batch filter over all samples.
    """
    env = dsp.butterworth(1, 1.5, 128.0) if envelope is None else envelope

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = np.array(state.get[0]).reshape(-1, 2) if state.exists else np.zeros((len(sos) + len(env), 2))
        part = pd.concat(list(parts)).query("status > 0").sort_values("sample_no")
        y, a = dsp.run_sections(part["value"].to_numpy(float), sos, kept[: len(sos)])
        e, b = dsp.run_sections(y * y, env, kept[len(sos) :])
        state.update((np.vstack([a, b]).reshape(-1).tolist(),))
        yield pd.DataFrame({"channel": key[0], "sample_no": part["sample_no"].to_numpy(), "filtered": y, "envelope": e})

    return samples.groupBy("channel").applyInPandasWithState(run, "channel string, sample_no long, filtered double, envelope double", "z array<double>", "append", GroupStateTimeout.NoTimeout)


def cues(spark, seconds: float, idle: float, move: float) -> DataFrame:
    """Alternating idle and move intervals: start, end, label."""
    n = int(seconds // (idle + move)) + 1
    k = F.col("id")
    both = spark.range(n).select(k, F.explode(F.array(F.struct((k * (idle + move)).alias("start"), (k * (idle + move) + idle).alias("end"), F.lit("idle").alias("label")), F.struct((k * (idle + move) + idle).alias("start"), ((k + 1) * (idle + move)).alias("end"), F.lit("move").alias("label")))).alias("c"))
    return both.select("c.*").filter(F.col("start") < seconds).withColumn("end", F.least("end", F.lit(float(seconds))))


def segment_sink(stream: DataFrame, path: str, checkpoint: str):
    """Writes a stream's valid samples as Parquet, one folder per segment, each batch once."""
    return valid(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("segment").outputMode("append").start()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset in local mode (tests), a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or os.path.join(tempfile.gettempdir(), "checkpoints", "sigloom")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """The result of a stream over what is there: every batch is written once, under its number, into the shared folder (a repeated batch
    replaces its own files); of a complete result the last batch counts, of an appended one all."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    numbers: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        numbers.append(number)
        where = f"{at}/out/batch={number if mode == 'append' else 0}"
        batch.write.mode("overwrite").parquet(where)

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out/batch=*") if numbers else spark.createDataFrame([], stream.schema)
