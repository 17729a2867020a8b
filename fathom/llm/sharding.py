"""Sharding by fixed virtual slots.

Every record hashes into one of ``n_slots`` virtual slots, for good. Bytes and rows are summed by slot (a table of
``n_slots`` rows whatever the corpus), the slots are dealt to shards by those bytes, and the map slot -> shard, which
lists all slots, is stored under a version number. ``place`` puts any documents by a stored map; rebalancing edits the
map: it moves whole slots and writes the next version.

Records of equal id and text cannot be told apart, so they are counted and numbered; the number is part of the hash
and spreads them over the slots. Within a slot, records are numbered in ``SUBS`` parts, so there are up to ``n_slots``
* ``SUBS`` windows.

Defined cases: a null text has size 16 and checksum 0; null ids hash like any value; repeated rows are records of
their own with places of their own; an empty table gives an empty result and a map over no bytes; extra columns
are ignored. Law: ``bytes`` (the sizes of the shards are near equal).
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.copies import numbered
from fathom.llm.texts import filled
from fathom.session import cut, shared_dir

N_SLOTS = 4096
SUBS = 16
OVERHEAD = 16  # bytes that each record costs besides its text
MAP_SCHEMA = "virtual_slot int, shard int, slot_bytes long, slot_rows long"


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Ids, sizes and slots, without the texts."""
    text = filled("text")
    equal = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = cut(equal.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), "counted")
    drawn = F.xxhash64("doc_id", "text_crc32", "copy")
    return numbered(counted, "n").select(
        "doc_id", "size", "text_crc32", F.pmod(drawn, F.lit(n_slots)).cast("int").alias("virtual_slot"), F.pmod(F.shiftrightunsigned(drawn, 48), F.lit(SUBS)).cast("int").alias("sub")
    )


def part_loads(rows: DataFrame) -> list[tuple[int, int, int, int]]:
    """Slot, part, bytes and rows: n_slots * SUBS rows at most reach the driver."""
    return [tuple(r) for r in rows.groupBy("virtual_slot", "sub").agg(F.sum("size"), F.count(F.lit(1))).collect()]


def slot_loads(parts: list[tuple[int, int, int, int]], n_slots: int = N_SLOTS) -> dict[int, tuple[int, int]]:
    """Bytes and rows of every slot, empty ones included."""
    loads = dict.fromkeys(range(n_slots), (0, 0))
    for slot, _, size, n in parts:
        loads[slot] = (loads[slot][0] + size, loads[slot][1] + n)
    return loads


def deal(loads: dict[int, tuple[int, int]], n_shards: int) -> dict[int, int]:
    """First map: the heaviest slot goes to the lightest shard; empty slots are spread by number."""
    heap = [(0, 0, shard) for shard in range(n_shards)]
    heapq.heapify(heap)
    dealt = {}
    for slot, (size, _) in sorted(loads.items(), key=lambda x: (-x[1][0], x[0])):
        total, slots, shard = heapq.heappop(heap)
        dealt[slot] = shard
        heapq.heappush(heap, (total + size, slots + 1, shard))
    return dealt


def rebalance(mapped: dict[int, int], loads: dict[int, tuple[int, int]], n_shards: int) -> dict[int, int]:
    """The edited map. Slots leave a shard only if it is above the mean or no longer exists, and enter the lightest."""
    edited = {s: mapped.get(s, n_shards) for s in loads}
    totals = [0] * n_shards
    homeless = []
    for slot, shard in edited.items():
        if shard < n_shards:
            totals[shard] += loads[slot][0]
        else:
            homeless.append(slot)
    mean = sum(b for b, _ in loads.values()) / max(1, n_shards)
    for slot in sorted(edited, key=lambda s: (-loads[s][0], s)):
        shard, size = edited[slot], loads[slot][0]
        if shard < n_shards and size and totals[shard] - size >= mean:
            totals[shard] -= size
            homeless.append(slot)
    heap = [(t, s) for s, t in enumerate(totals)]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda s: (-loads[s][0], s)):
        total, shard = heapq.heappop(heap)
        edited[slot] = shard
        heapq.heappush(heap, (total + loads[slot][0], shard))
    return edited


def store_map(spark: SparkSession, mapped: dict[int, int], loads: dict[int, tuple[int, int]], folder: str, version: int) -> DataFrame:
    """Write one version of the map, which stays as it is from then on."""
    rows = [(slot, shard, *loads[slot]) for slot, shard in sorted(mapped.items())]
    path = f"{folder}/version={version}"
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.schema(MAP_SCHEMA).parquet(path)


def stored_map(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, DataFrame]:
    """The number and rows of a stored version, the latest by default."""
    versions = spark.read.parquet(folder)
    version = version or versions.agg(F.max("version")).first()[0]
    return version, versions.where(F.col("version") == version).drop("version")


def rebalance_stored(spark: SparkSession, folder: str, n_shards: int) -> DataFrame:
    """Edit the latest version of a stored map for another number of shards and store it as the next version. Only the
    map is read; rows of slots that stay need not move."""
    version, rows = stored_map(spark, folder)
    rows = rows.collect()
    loads = {r.virtual_slot: (r.slot_bytes, r.slot_rows) for r in rows}
    return store_map(spark, rebalance({r.virtual_slot: r.shard for r in rows}, loads, n_shards), loads, folder, version + 1)


def _placed(rows: DataFrame, parts: list[tuple[int, int, int, int]], mapped: dict[int, int]) -> DataFrame:
    starts, filled_to = [], {}
    for slot, sub, _, n in sorted(parts):
        first = filled_to.get(mapped[slot], 0)
        starts.append((slot, sub, mapped[slot], first))
        filled_to[mapped[slot]] = first + n
    starts = rows.sparkSession.createDataFrame(starts, "virtual_slot int, sub int, shard int, first_place long")
    place = F.row_number().over(Window.partitionBy("virtual_slot", "sub").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("place", place)
        .join(F.broadcast(starts), ["virtual_slot", "sub"])  # n_slots * SUBS rows at most
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first_place") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
        )
    )


def place(docs: DataFrame, folder: str, version: int | None = None) -> DataFrame:
    """The documents by a stored map, whatever documents it was made from; columns as from ``shard``."""
    mapped = {r.virtual_slot: r.shard for r in stored_map(docs.sparkSession, folder, version)[1].collect()}
    rows = cut(records(docs, len(mapped)), "records")
    return _placed(rows, part_loads(rows), mapped)


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place within the shard, from 0, without gaps), grown_shard and
    virtual_slot, by a new map that is stored in ``folder`` as version 1. For a stored map, see ``place``."""
    spark = docs.sparkSession
    rows = cut(records(docs, n_slots), "records")
    parts = part_loads(rows)
    loads = slot_loads(parts, n_slots)
    mapped = deal(loads, n_shards)
    store_map(spark, mapped, loads, folder or f"{shared_dir(spark)}/slot-maps/{uuid.uuid4().hex}", 1)
    return _placed(rows, parts, mapped)
