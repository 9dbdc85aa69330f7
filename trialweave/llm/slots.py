"""Sharding by fixed virtual slots: records hash into thousands of slots, and a small versioned map sends slots to shards.

A record's slot follows from its id alone, so it never changes. Bytes are summed for each
slot; the map from slots to shards is a table of ``slots`` rows a version. Rebalancing
edits the map: slots move from shards with too many bytes to shards with too few, and the
edited map is stored as the next version beside the others. Records follow their slots.

Law: ``bytes``. The sizes of the shards come as near to equal as whole slots allow.

Only the map (``slots`` rows, whatever the input) reaches the driver and is broadcast. The
place of a record in its shard comes from the counts of the slots before its own in the
shard and a window within the slot, so no task holds a shard.

Edge cases: a null text takes no bytes (size 1); a null id is an id of its own, in one
slot; rows that repeat take a place each, ties in any order; an empty table gives no rows
and leaves the map as it was; a record larger than a shard's share leaves that shard the
largest; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialweave.llm.scratch import materialize, new_path

SLOTS = 4096
SHARDS = 8


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """Version 0: slots go round the shards."""
    return [slot % shards for slot in range(slots)]


def rebalanced(now: list[int], sizes: list[int], shards: int) -> list[int]:
    """The map, edited until no move of one slot, or exchange of two, from the largest to the smallest shard brings them nearer."""
    to = [min(shard, shards - 1) for shard in now]
    for _ in range(4 * len(now)):
        load = [0] * shards
        for slot, shard in enumerate(to):
            load[shard] += sizes[slot]
        high, low = load.index(max(load)), load.index(min(load))
        gap = load[high] - load[low]
        give = sorted(s for s in range(len(to)) if to[s] == high)
        take = sorted((s for s in range(len(to)) if to[s] == low), key=lambda s: sizes[s])
        best = min(((abs(gap - 2 * sizes[s]), s, -1) for s in give if sizes[s]), default=(gap, -1, -1))
        ordered, k = sorted(give, key=lambda s: sizes[s]), 0
        for s in ordered:  # for each slot given, the slot taken back whose size leaves half the gap
            while k + 1 < len(take) and sizes[s] - sizes[take[k + 1]] >= gap / 2:
                k += 1
            for t in take[k : k + 2]:
                if sizes[s] > sizes[t]:
                    best = min(best, (abs(gap - 2 * (sizes[s] - sizes[t])), s, t))
        if best[0] >= gap:
            break
        to[best[1]] = low
        if best[2] >= 0:
            to[best[2]] = high
    return to


def _rows(spark: SparkSession, version: int, to: list[int]) -> DataFrame:
    """A map as a table, from a literal."""
    entry = F.posexplode(F.array(*[F.lit(x) for x in to])) if len(to) <= 16 else F.posexplode(F.split(F.lit(",".join(map(str, to))), ","))
    return spark.range(1, numPartitions=1).select(entry.alias("virtual_slot", "shard")).select(F.lit(version).alias("version"), "virtual_slot", F.col("shard").cast("int").alias("shard"))


class SlotMap:
    """A folder of map versions; each is written once and stays."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "slot-map")

    def store(self, version: int, to: list[int]) -> None:
        _rows(self.spark, version, to).drop("version").write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def table(self, version: int | None = None) -> DataFrame:
        """virtual_slot, shard of one version, the newest if not given."""
        every = self.spark.read.parquet(self.path)
        version = every.agg(F.max("version")).first()[0] if version is None else version
        return every.where(F.col("version") == version).select("virtual_slot", "shard")

    def newest(self) -> tuple[int, list[int]]:
        every = self.spark.read.parquet(self.path)
        version = every.agg(F.max("version")).first()[0]
        return version, [r["shard"] for r in self.table(version).orderBy("virtual_slot").collect()]


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, stored: SlotMap | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard), grown_shard (null: not this law), virtual_slot, map_version.

    ``stored``: the map to edit; without one, a new map is stored in the shared folder.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    records = materialize(
        docs.select(F.col(key).alias("doc_id"), (F.octet_length(content) + 1).cast("bigint").alias("size"), F.crc32(content).alias("text_crc32"), slot_of(F.col(key), slots).alias("virtual_slot")), "shard-records"
    )
    counted = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    sizes, rows = [0] * slots, [0] * slots
    for r in counted.collect():  # at most one row a slot
        sizes[r["virtual_slot"]], rows[r["virtual_slot"]] = r["bytes"], r["rows"]
    if stored is None:
        stored = SlotMap(spark)
        stored.store(0, first_map(slots, shards))
    version, now = stored.newest()
    to = rebalanced(now, sizes, shards)
    if to != now:
        version += 1
        stored.store(version, to)
    before, filled = [0] * slots, [0] * shards
    for slot in range(slots):
        before[slot] = filled[to[slot]]
        filled[to[slot]] += rows[slot]
    places = _rows(spark, version, before).select("virtual_slot", F.col("shard").cast("bigint").alias("_before")) if max(before) < 2**31 else _long_rows(spark, before)
    moved = F.broadcast(stored.table(version).join(F.broadcast(places), "virtual_slot"))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    return records.join(moved, "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_before") + F.row_number().over(order) - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(version).alias("map_version"),
    )


def _long_rows(spark: SparkSession, values: list[int]) -> DataFrame:
    entry = F.posexplode(F.split(F.lit(",".join(map(str, values))), ","))
    return spark.range(1, numPartitions=1).select(entry.alias("virtual_slot", "_before")).select("virtual_slot", F.col("_before").cast("bigint").alias("_before"))
