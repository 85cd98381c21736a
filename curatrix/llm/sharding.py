"""Sharding by fixed virtual slots: records hash into slots, slots belong to shards by a stored map with versions.

A record's slot follows from its id alone and never changes. Which shard holds a slot stands in a map of a few thousand rows,
and only that map is edited: `rebalanced` moves slots from the shards that hold too many bytes to those that hold too few,
`grown` moves slots to one more shard and nowhere else. Each edit is a new version of the map; readers stay on theirs.

A slot with over half a shard's share of the bytes (an id that a third of all rows repeat, or null) is split into parts, to which its
rows are dealt by their place in the table; the parts belong to shards as slots do.

Everything is DataFrame functions. Ids, sizes and checksums are written once, and texts are read once. What meets in one task has
a row for each slot or part, of which there are at most slots + 10 * shards; the map that is broadcast is bounded in the same way.
Rows are numbered within (file of the written table, shard), and counts of earlier files are added, so no shard is sorted or
gathered as a whole.

A null text counts as empty, a null id as an id of its own. Very long texts, repeated rows and ids, and equal texts each are
rows of their own. Empty tables give empty results, the map all the same. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .scratch import Scratch

SHARDS, SLOTS = 16, 4096
#: A slot with over half of a shard's even share is split into parts of about 1 / PARTS of that share.
PARTS = 8


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(slots)).cast("int")


class SlotMap:
    """A slot-to-shard map with versions in a folder: slot, part, shard."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self) -> DataFrame:
        return self.spark.read.schema("slot int, part int, shard int, version int").parquet(self.path)

    def version(self) -> int:
        return self._read().agg(F.max("version")).first()[0]

    def at(self, version: int | None = None) -> DataFrame:
        """slot, part, shard of a version, by default the last one."""
        return self._read().where(F.col("version") == (self.version() if version is None else version)).select("slot", "part", "shard")

    def put(self, table: DataFrame, version: int) -> SlotMap:
        table.select("slot", "part", "shard", F.lit(version).alias("version")).coalesce(1).write.mode("append").partitionBy("version").parquet(self.path)
        return self

    def create(self, shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        """Version 0: neighbouring slots, as many for each shard."""
        return self.put(self.spark.range(slots).select(F.col("id").cast("int").alias("slot"), F.lit(0).alias("part"), F.expr(f"cast(id * {shards} div {slots} AS int)").alias("shard")), 0)

    def edit(self, change) -> SlotMap:
        """One more version: change(the last one)."""
        last = self.version()
        return self.put(change(self.at(last)), last + 1)


def split(table: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """The map with as many parts of a slot as its weight (slot, bytes, rows) asks for, all of them in the slot's shard."""
    share = F.sum("bytes").over(W.partitionBy(F.lit(1))) / shards
    parts = weights.select("slot", F.when(F.col("bytes") * 2 > share, F.least(F.col("rows"), F.ceil(F.col("bytes") * PARTS / share))).otherwise(1).cast("int").alias("parts"))
    whole = table.where("part = 0").join(F.broadcast(parts), "slot", "left")
    return whole.select("slot", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)) - 1)).alias("part"), "shard")


def part_of(ticket: Column, parts: Column) -> Column:
    return F.pmod(ticket, parts).cast("int")


def _weighed(table: DataFrame, weights: DataFrame) -> DataFrame:
    """The map with bytes (0 where a part has no rows), and the running sum within its shard, the largest first."""
    largest = W.partitionBy("shard").orderBy(F.desc("bytes"), "slot", "part")
    out = table.join(F.broadcast(weights.select("slot", "part", "bytes")), ["slot", "part"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))
    return out.withColumn("sum", F.sum("bytes").over(largest.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("nth", F.row_number().over(largest))


def rebalanced(table: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """The map edited so that shards hold nearly as many bytes each (weights: slot, part, bytes).

    A shard keeps its largest slots as far as they fit into an even share; the others, the largest first, each go to the shard that
    then holds the least. One row holds them all, at most a map's rows.
    """
    even = F.sum("bytes").over(W.partitionBy(F.lit(1))) / shards
    marked = _weighed(table, weights).withColumn("stays", (F.col("sum") <= even) | (F.col("nth") == 1) | (F.col("bytes") == 0))
    loads = marked.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    loads = loads.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(loads), "shard", "left")
    loads = loads.agg(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0).cast("long")).alias("load")))).alias("loads"))
    moved = marked.where("not stays").agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "slot", "part"))).alias("moved"))

    def give(state: Column, unit: Column) -> Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"]))
        return F.struct(F.transform(state["loads"], lambda x, i: F.when(i + 1 == least, x - unit["less"]).otherwise(x)).alias("loads"), F.concat(state["shards"], F.array((least - 1).cast("int"))).alias("shards"))

    start = F.struct(F.transform("loads", lambda x: x["load"]).alias("loads"), F.array().cast("array<int>").alias("shards"))
    both = loads.withColumn("one", F.lit(1)).join(moved.withColumn("one", F.lit(1)), "one")  # a row each
    given = both.select(F.explode(F.arrays_zip(F.col("moved").alias("unit"), F.aggregate("moved", start, give)["shards"].alias("shard"))).alias("g"))
    return marked.where("stays").select("slot", "part", "shard").unionByName(given.select("g.unit.slot", "g.unit.part", "g.shard"))


def grown(table: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """The map for one more shard, whose number is `shards`: every other one keeps its largest slots as far as they fit into the new even share, and gives it the rest."""
    even = F.sum("bytes").over(W.partitionBy(F.lit(1))) / (shards + 1)
    stays = (F.col("sum") <= even) | (F.col("nth") == 1)
    return _weighed(table, weights).select("slot", "part", F.when(stays, F.col("shard")).otherwise(F.lit(shards)).alias("shard"))


def measured(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """key, size, crc, vslot, ticket, file, place: a written row for each row of docs, without its text."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(key).alias("key"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t.cast("binary")).alias("crc"), slot_of(F.col(key), slots).alias("vslot"))
    rows = scratch.save(own).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    return rows.withColumn("ticket", F.xxhash64(F.regexp_extract("file", r"part-(\d+)", 1), "place"))


def weigh(rows: DataFrame) -> DataFrame:
    """slot, bytes, rows."""
    return rows.groupBy(F.col("vslot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _by_slot(table: DataFrame) -> DataFrame:
    """vslot, shards: the shards of a slot's parts in order, a row for each slot."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part", "shard"))), lambda x: x["shard"])
    return F.broadcast(table.groupBy(F.col("slot").alias("vslot")).agg(listed.alias("shards")))


def weigh_parts(rows: DataFrame, table: DataFrame) -> DataFrame:
    """slot, part, bytes under a map."""
    parted = rows.join(_by_slot(table), "vslot").select("vslot", part_of(F.col("ticket"), F.size("shards")).alias("part"), "size")
    return parted.groupBy(F.col("vslot").alias("slot"), "part").agg(F.sum("size").alias("bytes"))


def placed(rows: DataFrame, table: DataFrame, name: str = "shard") -> DataFrame:
    """rows with their shard under a map."""
    return rows.join(_by_slot(table), "vslot").withColumn(name, F.get("shards", part_of(F.col("ticket"), F.size("shards")))).drop("shards")


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with `slot`, their place in their shard, gapless from 0."""
    ranked = scratch.save(rows.withColumn("rank", F.row_number().over(W.partitionBy("file", "shard").orderBy("place")) - 1))
    counts = ranked.groupBy("file", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return ranked.join(counts.select("file", "shard", before.alias("before")), ["file", "shard"]).withColumn("slot", F.col("rank") + F.col("before")).drop("rank", "before")


def shard(docs: DataFrame, scratch: Scratch, shards: int = SHARDS, slots: int = SLOTS, key: str = "doc_id", text: str = "text", path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Rows as `measured`, with shard and slot, and the map: version 0 is even in slots, 1 splits heavy slots, 2 is balanced by bytes."""
    rows = measured(docs, scratch, key, text, slots)
    slot_map = SlotMap(docs.sparkSession, path or f"{scratch.root}/slot_map").create(shards, slots)
    slot_map.edit(lambda last: split(last, weigh(rows), shards))
    weights = weigh_parts(rows, slot_map.at(1))
    slot_map.edit(lambda last: rebalanced(last, weights, shards))
    return numbered(placed(rows, slot_map.at(2)), scratch), slot_map


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents: the law is `bytes`; then virtual_slot."""
    rows, _ = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
    return rows.select(F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
