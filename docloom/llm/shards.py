"""Sharding over fixed virtual slots, with DataFrame functions only.

Records are hashed into some thousands of virtual slots, bytes are summed for each
slot, and a map says which shard has which slot. The map is stored in versions: each
edit writes the slots that change hands, and a version is what the edits up to it
leave. Rebalancing keeps a slot where it is as long as its shard stays below the even
share (with some slack) and gives the others, largest first, to the shard with the
least bytes; so a new shard takes from those that are over their share, and nothing
else moves.

A record's slot depends on its key, its text and its number among equal records, so
equal records spread over the slots like others and no slot is hot, whatever a key
holds. Only keys, sizes and hashes are shuffled, never texts. Positions in a shard are
positions in the slot plus what the shard's slots before it hold, so no shard is ever in
one task.

Results for odd input: null texts have size 1 and checksum 0, as empty ones; rows with a
null key are rows as any other; repeated rows are rows of their own; an empty table
gives no rows (its map still deals all slots out). A single record larger than a
shard's even share makes its shard as large as that record. Columns of other names
are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shared_folder, table

#: Virtual slots; the map and what is broadcast of it have as many rows, whatever the input.
SLOTS = 4_096
#: Rows that one row of a repeated record is unfolded into at once.
UNFOLD = 4_096
#: By this share a shard may exceed the even one before slots leave it.
SLACK = 0.002


def distinct_records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, body, n): equal rows of ``docs`` are one row with their number."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("body"))
    return rows.groupBy("doc_id", "size", "text_crc32", "body").agg(F.count("*").alias("n"))


def records(distinct: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, body, copy, virtual_slot): distinct records unfolded in two steps, each copy with a number."""
    once = distinct.where("n = 1").drop("n").withColumn("copy", F.lit(0).cast("long"))
    parts = distinct.where("n > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / UNFOLD))))
    ends = F.least(F.col("n"), (F.col("part") + 1) * UNFOLD) - 1
    again = parts.repartition("doc_id", "body", "part").withColumn("copy", F.explode(F.sequence(F.col("part") * UNFOLD, ends))).drop("n", "part")
    return once.unionByName(again).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "body", "copy"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, n) for every slot, also those that no record is in."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n"))


def balanced(sizes: DataFrame, shards: int, now: DataFrame | None = None, slack: float = SLACK) -> DataFrame:
    """(virtual_slot, shard): the map for ``shards`` shards that moves few slots of ``now`` (none: all are free).

    The slots, as many as the map has rows, are one array: a slot keeps its shard while
    that has room up to the even share; the rest go, by size, to the lightest shard.
    """
    old = sizes.join(now.select("virtual_slot", "shard"), "virtual_slot", "left") if now is not None else sizes.withColumn("shard", F.lit(None).cast("int"))
    # an empty slot weighs one byte, so that empty slots are dealt out too
    weight = F.greatest("bytes", F.lit(1))
    row = old.agg(F.array_sort(F.collect_list(F.struct((-weight).alias("rank"), "virtual_slot", weight.alias("weight"), "shard"))).alias("slots"), F.sum(weight).alias("total"))
    room = F.ceil(F.col("total") / shards * (1 + slack))

    def heavier(loads: Column, at: Column, by: Column) -> Column:
        return F.transform(loads, lambda x, i: F.when(i == at, x + by).otherwise(x))

    def keep(state: Column, x: Column) -> Column:
        own = F.get(state["loads"], x["shard"])
        stays = F.coalesce(own + x["weight"] <= room, F.lit(False))
        return F.struct(
            F.when(stays, heavier(state["loads"], x["shard"], x["weight"])).otherwise(state["loads"]).alias("loads"),
            F.when(stays, F.array_append(state["map"], F.struct(x["virtual_slot"].alias("virtual_slot"), x["shard"].alias("shard")))).otherwise(state["map"]).alias("map"),
            F.when(stays, state["free"]).otherwise(F.array_append(state["free"], F.struct(x["virtual_slot"].alias("virtual_slot"), x["weight"].alias("weight")))).alias("free"),
        )

    def give(state: Column, x: Column) -> Column:
        # loads are in order: the first is the lightest
        loads = F.sort_array(F.transform(state["loads"], lambda y, i: F.when(i == 0, F.struct((y["load"] + x["weight"]).alias("load"), y["shard"].alias("shard"))).otherwise(y)))
        return F.struct(loads.alias("loads"), F.array_append(state["map"], F.struct(x["virtual_slot"].alias("virtual_slot"), state["loads"][0]["shard"].alias("shard"))).alias("map"))

    empty = F.expr(f"named_struct('loads', array_repeat(0L, {int(shards)}), 'map', cast(array() as array<struct<virtual_slot:int,shard:int>>), 'free', cast(array() as array<struct<virtual_slot:int,weight:bigint>>))")
    if now is None:
        free = F.transform("slots", lambda x: F.struct(x["virtual_slot"].alias("virtual_slot"), x["weight"].alias("weight")))
        kept = row.select(empty.withField("free", free).alias("kept"))
    else:
        kept = row.select(F.aggregate("slots", empty, keep).alias("kept"))
    loads = F.sort_array(F.transform("kept.loads", lambda y, i: F.struct(y.alias("load"), i.alias("shard"))))
    out = kept.select(F.aggregate("kept.free", F.struct(loads.alias("loads"), F.col("kept.map").alias("map")), give).alias("s"))
    return out.select(F.inline("s.map"))


class SlotMaps:
    """The versions of a map in a folder that driver and executors share; each version's folder holds the slots that it changes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _edits(self) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int, version int").parquet(self.folder)

    def latest(self) -> int:
        """The last version, 0 if there is none; an edit that changes nothing has a folder too."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        return max((int(x.removeprefix("version=")) for x in names if x.startswith("version=")), default=0)

    def read(self, version: int) -> DataFrame:
        """(virtual_slot, shard) of a version."""
        return self._edits().where(F.col("version") <= version).groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))

    def store(self, new: DataFrame) -> int:
        """Write what ``new`` changes as the next version and return its number; the edit fails if another one has taken that number."""
        version = self.latest() + 1
        changed = new.select("virtual_slot", "shard")
        if version > 1:
            changed = changed.join(self.read(version - 1).withColumnRenamed("shard", "was"), "virtual_slot", "left").where(~F.col("was").eqNullSafe(F.col("shard"))).drop("was")
        changed.coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/version={version}")
        return version

    def rebalance(self, sizes: DataFrame, shards: int, slack: float = SLACK) -> int:
        """Edit the latest version for the sizes and the number of shards of now."""
        last = self.latest()
        return self.store(balanced(sizes, shards, self.read(last) if last else None, slack))


def placed(rows: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the position in it: gapless from 0. ``sizes`` and ``slot_map`` have a row for each virtual slot."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(sizes, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "body", "copy")
    numbered = rows.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), "virtual_slot").withColumn("slot", (F.col("start") + F.col("at")).cast("long")).drop("start", "at")  # as many rows as virtual slots


def sharded(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", slots: int = SLOTS, maps: SlotMaps | None = None) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot, virtual_slot, map_version) of all ``docs``, dealt by the newest map.

    ``maps`` holds the versions; it is rebalanced for what ``docs`` holds now.
    Without it a first version is stored in the shared folder.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = records(scratch.table(distinct_records(docs, key, text)), slots)
    sizes = scratch.table(slot_sizes(rows, slots))
    maps = maps or SlotMaps(spark, f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}")
    version = maps.rebalance(sizes, shards)
    out = placed(rows, sizes, maps.read(version))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot", F.lit(version).alias("map_version"))


def op11_shards(spark, sf_dir: str) -> DataFrame:
    law = (F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))
    return sharded(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", *law, "shard", "slot", "virtual_slot", "map_version")
