"""Streams against the same computation on batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import dsp
from sigloom.sources import simulated
from sigloom.streaming import live


def replayed(spark, df, tmp_path, parts, key):
    """df as a stream of so many files."""
    for k in range(parts):
        df.filter(F.col(key) % 1000 * parts / 1000 >= 0).filter(F.floor(F.col(key) * parts / (df.agg(F.max(key)).first()[0] + 1)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def test_stateful_filter_equals_batch(spark, tmp_path):
    df = simulated.batch(spark, ["10Hz", "10HzSquare"], 128, 2).withColumn("status", F.when(F.col("sample_no") % 50 == 7, 0).otherwise(2)).select("channel", "sample_no", "status", "value")
    sos = dsp.butterworth(2, 8, 128)
    out = drained(live.filtered(replayed(spark, df, tmp_path, 3, "sample_no"), sos), "filtered")
    for ch in ("10Hz", "10HzSquare"):
        x = np.array([r["value"] for r in df.filter((F.col("channel") == ch) & (F.col("status") > 0)).orderBy("sample_no").collect()])
        y = np.array([r["filtered"] for r in out.filter(F.col("channel") == ch).orderBy("sample_no").collect()])
        assert np.allclose(y, dsp.run_sections(x, sos)[0])


def test_windows_equal_batch(spark, tmp_path):
    df = spark.range(300).select(F.timestamp_seconds(F.lit(1700000000) + F.col("id") * 7).alias("ts"), (F.col("id") % 3).alias("u"), F.col("id").cast("double").alias("value"), "id")
    stream = replayed(spark, df, tmp_path, 2, "id")
    out = drained(live.tumbling(stream, "ts", "1 minute", ["u"]), "windows", "complete")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, live.tumbling(df, "ts", "1 minute", ["u"]).collect()))


def test_packet_loss(spark):
    df = spark.createDataFrame([(1, k, d) for k, d in enumerate([0, 1, 2, 5, 6, 63, 0])], "seg int, sample_no int, diag int")
    row = live.packet_loss(df, ["seg"], "sample_no").first()
    assert (row["lost"], row["n"]) == (2, 7)
    narrow = spark.createDataFrame([(1, k, d) for k, d in enumerate([0, 2, 4, 10, 12, 62, 0])], "seg int, sample_no int, diag int")
    assert live.packet_loss(narrow, ["seg"], "sample_no", wide=False).first()["lost"] == pytest.approx(2 + 24)


def test_stateless_steps(spark):
    df = spark.createDataFrame([(2, [1.0, 3.0]), (6, [2.0, 2.0]), (0, [0.0, 0.0])], "status int, ch array<double>")
    assert live.valid(df).count() == 2
    assert [r["trigger"] for r in live.status_bits(df).collect()] == [False, True, False]
    assert df.select(live.referenced(F.col("ch")).alias("r")).first()["r"] == [-1.0, 1.0]
    p = spark.createDataFrame([("a", k, 1.0) for k in range(8)] + [("b", k, float(k)) for k in range(8)], "ch string, k int, p2p double")
    assert {r["ch"]: r["stuck"] for r in live.stuck(p, ["ch"], "k").collect()} == {"a": True, "b": False}
    c = live.cues(spark, 25, 4, 6).orderBy("start").collect()
    assert [r["label"] for r in c] == ["idle", "move", "idle", "move", "idle", "move"] and c[-1]["end"] == 25
