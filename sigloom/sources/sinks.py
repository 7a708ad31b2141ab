"""Exports: partitioned recordings, channels merged by rate, and tables that are only written if their content changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export(blocks: DataFrame, path: str) -> None:
    """One folder per segment and channel; folders of other segments stay."""
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment", "channel").parquet(path)


def merged_by_rate(blocks: DataFrame, channels: list[str]) -> DataFrame:
    """One row per segment and sampling rate, with a column of samples for each channel of that rate."""
    return blocks.groupBy("segment", "fs").pivot("channel", channels).agg(F.first("values"))


def content_hash(df: DataFrame) -> str:
    """A digest of the rows, whatever their order: sums of row hashes, added up where the rows are."""
    h = F.xxhash64(*df.columns)
    n, a, b = df.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1 << 31))), F.sum(F.pmod(F.shiftright(h, 31), F.lit(1 << 31)))).first()
    return f"{n:x}-{a or 0:x}-{b or 0:x}"


def save_if_changed(df: DataFrame, path: str, name: str) -> bool:
    """Writes df as path/name-hash unless a table of that content is there; says whether it wrote."""
    spark: SparkSession = df.sparkSession
    target = f"{path}/{name}-{content_hash(df)}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(target + "/_SUCCESS")
    if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return False
    df.write.mode("overwrite").parquet(target)
    return True
