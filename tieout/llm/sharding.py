"""Sharding by fixed virtual slots.

A record's slot is a hash of its key and never changes. Which shard serves a slot
is written in a versioned map; rebalancing edits the map, not the hash. Bytes are
summed per slot, so an edit can weigh what it moves. The map and the loads have one
entry per slot, 4,096 at any size of the data: only they ever reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096

#: Parts that a slot is ordered in, so that no task orders a whole slot.
PARTS = 8


@dataclass(frozen=True)
class SlotMap:
    """Shard of every slot, as of one version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def first(shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 0: slots dealt round; decided by the number of shards alone."""
        return SlotMap(0, shards, tuple(s % shards for s in range(slots)))

    def grown(self) -> SlotMap:
        """One shard more, which takes its even share of slots from the others; no slot moves between those."""
        shard_of, new = list(self.shard_of), self.shards
        held: dict[int, list[int]] = {s: [] for s in range(self.shards)}
        for slot, shard in enumerate(self.shard_of):
            held[shard].append(slot)
        for _ in range(len(shard_of) // (new + 1)):
            giver = max(held, key=lambda s: (len(held[s]), -s))
            shard_of[held[giver].pop()] = new
        return SlotMap(self.version + 1, new + 1, tuple(shard_of))

    def rebalanced(self, loads: dict[int, int]) -> SlotMap:
        """Moves single slots from the fullest to the emptiest shard while that lowers the larger of both."""
        shard_of = list(self.shard_of)
        held: dict[int, dict[int, int]] = {s: {} for s in range(self.shards)}
        for slot, shard in enumerate(shard_of):
            held[shard][slot] = loads.get(slot, 0)
        total = {s: sum(x.values()) for s, x in held.items()}
        for _ in range(len(shard_of)):
            full, empty = max(total, key=lambda s: (total[s], -s)), min(total, key=lambda s: (total[s], s))
            gap = total[full] - total[empty]
            fits = [(abs(gap - 2 * b), slot) for slot, b in held[full].items() if 0 < b < gap]
            if not fits:
                break
            slot = min(fits)[1]
            b = held[full].pop(slot)
            held[empty][slot] = b
            shard_of[slot] = empty
            total[full] -= b
            total[empty] += b
        return SlotMap(self.version + 1, self.shards, tuple(shard_of))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, slot, shard) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")


def store_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Adds a version to the stored map; earlier ones stay readable."""
    slot_map.table(spark).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the latest where none is named."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    rows = sorted((r.virtual_slot, r.shard, r.shards) for r in stored.where(F.col("version") == version).collect())
    if not rows:
        raise ValueError(f"no version {version} of the slot map")
    return SlotMap(version, rows[0][2], tuple(r[1] for r in rows))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slot: str = "virtual_slot", size: str = "size") -> dict[int, int]:
    """Bytes per slot: at most one row per slot comes to the driver."""
    return {r[0]: r[1] for r in records.groupBy(slot).agg(F.sum(size)).collect()}


def assigned(records: DataFrame, slot_map: SlotMap, name: str, slot: str = "virtual_slot") -> DataFrame:
    """Adds the shard that ``slot_map`` gives each record; the map has a fixed number of rows."""
    m = slot_map.table(records.sparkSession).select(F.col("virtual_slot").alias("_slot"), F.col("shard").alias(name))
    return records.join(F.broadcast(m), F.col(slot) == F.col("_slot")).drop("_slot")


def positions(records: DataFrame, shard: str, name: str, slot: str, order: list[str]) -> DataFrame:
    """Gapless places from 0 within each shard.

    A shard is never ordered as a whole: each part of a virtual slot is numbered on
    its own, after the rows of the shard's earlier parts, which are counted first.
    Rows equal in ``order`` are interchangeable.
    """
    part = records.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in order], F.lit(PARTS)), F.lit(PARTS)).cast("int"))
    counts = part.groupBy(shard, slot, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(shard).orderBy(slot, "_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(slot).alias("_s"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(slot, "_part").orderBy(*order))
    placed = part.withColumn("_local", local)
    # one row per part of a slot: at most SLOTS * PARTS rows
    placed = placed.join(F.broadcast(starts), (F.col(slot) == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return placed.withColumn(name, F.col("_start") + F.col("_local") - 1).drop("_part", "_local", "_start", "_s", "_p")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), checksum and virtual slot of every document; texts go no further."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        slot_of(F.col("doc_id"), slots).alias("virtual_slot"),
    )
