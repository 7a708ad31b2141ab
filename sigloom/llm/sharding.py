"""Operator 1: sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots (thousands; the number never changes in the life of a corpus).
Bytes are aggregated per slot, and a small versioned table maps slots to shards. Rebalancing, also to another number of
shards, edits that table alone: a slot stays where it is while its shard has room, and only the rest move.

Cases: a null text has size 1 and CRC 0; null ids are hashed by their text's CRC alone; repeated rows share a virtual slot
and get different places; an empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.common import shared_dir, table, written

SLOTS = 4096


def sized(docs: DataFrame, n_slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every row: a map over the rows, whole texts read once."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_totals(rows: DataFrame) -> DataFrame:
    """Rows and bytes per virtual slot: at most n_slots rows, added up before the shuffle."""
    return rows.groupBy("virtual_slot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def first_map(spark: SparkSession, n_shards: int, n_slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt in turn."""
    slot = F.col("id").cast("int")
    return spark.range(n_slots).select(slot.alias("virtual_slot"), F.pmod(slot, F.lit(n_shards)).alias("shard"), F.lit(0).alias("version"))


def rebalanced(slot_map: DataFrame, totals: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map, for n_shards shards (as many as before, more or fewer).

    One fold over the slots, largest first: a slot stays on its shard if that holds no more than its fair part with it,
    else it goes to the shard with the fewest bytes. The fold's array has one entry per slot, so its size is fixed.
    """
    entries = slot_map.join(totals, "virtual_slot", "left").select(
        F.struct((-F.coalesce("n_bytes", F.lit(0))).alias("minus"), "virtual_slot", F.col("shard").alias("was"), (F.col("version") + 1).alias("version")).alias("e")
    )
    one = entries.agg(F.array_sort(F.collect_list("e")).alias("slots"), F.expr("bigint(ceil(sum(-e.minus) / %d))" % n_shards).alias("fair"))
    fold = f"""
        aggregate(
            slots,
            named_struct('loads', array_repeat(0L, {n_shards}), 'put', cast(array() as array<int>)),
            (acc, s) -> transform(
                array(if(s.was < {n_shards} and coalesce(get(acc.loads, s.was), 0L) - s.minus <= fair, s.was, cast(array_position(acc.loads, array_min(acc.loads)) as int) - 1)),
                k -> named_struct('loads', transform(acc.loads, (v, i) -> if(i = k, v - s.minus, v)), 'put', concat(acc.put, array(k)))
            )[0]
        ).put"""
    return (
        one.select("slots", F.expr(fold).alias("put"))
        .select(F.posexplode("slots").alias("i", "e"), "put")
        .select("e.virtual_slot", F.expr("put[i]").alias("shard"), "e.version")
    )


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds the map's version to the table at path; older versions stay."""
    slot_map.coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest unless told otherwise."""
    stored = spark.read.parquet(path)
    if version is None:
        return stored.join(F.broadcast(stored.agg(F.max("version").alias("version"))), "version").select("virtual_slot", "shard", "version")
    return stored.filter(F.col("version") == version).select("virtual_slot", "shard", "version")


def placed(rows: DataFrame, slot_map: DataFrame, totals: DataFrame) -> DataFrame:
    """Each row's shard and its place there, gapless from 0.

    A row's place is its rank in its virtual slot plus the rows of the shard's earlier slots, so no task sees a whole shard.
    The map is broadcast: it has one row per virtual slot, whatever the corpus.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.join(totals, "virtual_slot").select("virtual_slot", "shard", "version", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("rank", rank).join(F.broadcast(offsets), "virtual_slot").withColumn("slot", F.col("offset") + F.col("rank") - 1)


def op1_sharding(spark: SparkSession, sf_dir: str, n_shards: int = 8) -> DataFrame:
    """All documents in shards 0 to 7 of nearly equal bytes."""
    rows = written(sized(table(spark, sf_dir, "documents")), "sized")
    totals = written(slot_totals(rows).coalesce(1), "slot-totals")
    path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    start = first_map(spark, n_shards)
    save_map(start, path)
    save_map(rebalanced(load_map(spark, path), totals, n_shards), path)
    return placed(rows, load_map(spark, path), totals).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )
