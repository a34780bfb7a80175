"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into ``slots`` virtual slots, far more than shards. Bytes are added up per slot,
and the map sends the largest slots first to the shard with the fewest bytes so far, so shards are
near equal by the law ``bytes``. The map is a small stored table of versions; adding a shard writes
a new version that moves just enough slots, all into the new shard, and every other slot stays.

The map has a fixed number of rows, so it is edited on the driver and broadcast. Rows are numbered
within their slot, then offset by the rows of the slots before it in the shard: no shard is sorted
or numbered in one task.

A slot with more than ``HEAVY`` of a shard's share, as rows that repeat make it, is dissolved: its
rows are dealt over all slots by their place in the table, and each slot counts with an equal part
of their bytes.

Defined results: a null or empty text has no bytes; a null ``doc_id`` is hashed with its text like
any other; repeated rows go to one slot unless that is dissolved; no rows give no rows. Other columns are ignored by
``shard_rows`` and kept by ``sharded_documents``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadpulse.session import stage, stage_path

SLOTS, SHARDS, OVERHEAD = 16384, 40, 16
#: Share of a shard's bytes beyond which a slot is dissolved.
HEAVY = 0.05
#: Odd, so without a common divisor with a number of slots that is a power of two.
STRIDE = 6151
_MAP = "version int, slot int, shard int"


def virtual_slot(slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")), F.lit(slots)).cast("int")


def row_size() -> Column:
    return F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + OVERHEAD


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    """Bytes per slot from (vslot, size): one row per slot, however many records."""
    return {r.vslot: r.bytes for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}


def first_map(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """Largest slots first, each to the shard with the fewest bytes; empty slots to the shard with the fewest slots."""
    owner = [0] * slots
    heap = [(0, 0, s) for s in range(shards)]
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        size, count, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (size + sizes.get(slot, 0), count + 1, shard))
    return owner


def grown_map(owner: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """A map for one more shard: slots move only into it, from the fullest shards, until it has its share."""
    owner, fill = list(owner), [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        fill[shard] += sizes.get(slot, 0)
        own[shard].append(slot)
    for slots in own:
        slots.sort(key=lambda s: (sizes.get(s, 0), -s))
    share, got = sum(fill) / (shards + 1), 0
    heap = [(-f, s) for s, f in enumerate(fill)]
    heapq.heapify(heap)
    while heap and got < share:
        full, shard = heapq.heappop(heap)
        while own[shard]:
            slot = own[shard].pop()
            size = sizes.get(slot, 0)
            if size and got + size <= share + size / 2:
                owner[slot], got = shards, got + size
                if -full - size > share:
                    heapq.heappush(heap, (full + size, shard))
                break
    return owner


def store_map(spark: SparkSession, path: str, owner: list[int], version: int) -> None:
    """Append a version; earlier ones stay readable."""
    table = spark.createDataFrame([(version, slot, shard) for slot, shard in enumerate(owner)], _MAP)
    table.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(slot, shard) of a version, the newest by default."""
    table = spark.read.schema(_MAP).parquet(path)
    wanted = F.lit(version) if version is not None else table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == wanted).select("slot", "shard")


def heavy_slots(sizes: dict[int, int], shards: int) -> list[int]:
    """Slots that would outweigh a shard's balance; at most shards / HEAVY of them."""
    limit = HEAVY * sum(sizes.values()) / shards
    return sorted(s for s, n in sizes.items() if n > limit)


def spread(sizes: dict[int, int], heavy: list[int], slots: int) -> dict[int, int]:
    """Bytes per slot with the bytes of dissolved slots in equal parts."""
    share = sum(sizes[s] for s in heavy) // slots
    return {s: (0 if s in set(heavy) else sizes.get(s, 0)) + share for s in range(slots)} if heavy else dict(sizes)


def grow_map(spark: SparkSession, path: str, sizes: dict[int, int]) -> int:
    """Edit the newest stored map for one more shard and store it as the next version, which is returned."""
    version = spark.read.schema(_MAP).parquet(path).agg(F.max("version")).first()[0]
    # A row per slot.
    owner = [r.shard for r in read_map(spark, path, version).orderBy("slot").collect()]
    store_map(spark, path, grown_map(owner, sizes, max(owner) + 1), version + 1)
    return version + 1


def _with_shard(rows: DataFrame, path: str, version: int, vslot: str, name: str) -> DataFrame:
    """The shard of a stored version for each row's slot; the map has one row per slot."""
    owner = read_map(rows.sparkSession, path, version).select(F.col("slot").alias("_slot"), F.col("shard").alias(name))
    return rows.join(F.broadcast(owner), F.col(vslot) == F.col("_slot")).drop("_slot")


def _mapped(rows: DataFrame, shards: int, slots: int, vslot: str = "vslot", size: str = "size", place: Column | None = None) -> tuple[DataFrame, str, dict[int, int]]:
    """Rows with a slot and a size to the same with the ``shard`` of a newly stored map; its path and bytes per slot.

    ``place`` tells rows apart that are equal in all columns.
    """
    spark = rows.sparkSession
    path = stage_path(spark, "slot-map")
    sizes = slot_bytes(rows.select(F.col(vslot).alias("vslot"), F.col(size).alias("size")))
    heavy = heavy_slots(sizes, shards)
    sizes = spread(sizes, heavy, slots)
    if heavy:
        place = F.monotonically_increasing_id() if place is None else place
        # One slot after the other, in steps that reach all of them.
        anew = F.pmod(place * STRIDE, F.lit(slots)).cast("int")
        rows = rows.withColumn(vslot, F.when(F.col(vslot).isin(heavy), anew).otherwise(F.col(vslot)))
    store_map(spark, path, first_map(sizes, shards, slots), 1)
    return _with_shard(rows, path, 1, vslot, "shard"), path, sizes


def shard_rows(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (its place in the shard), grown_shard, vslot, next_shard.

    ``next_shard`` is the row's shard in the map's second version, edited for one more shard.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_size().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        virtual_slot(slots).alias("vslot"),
        F.monotonically_increasing_id().alias("_place"),
    )
    rows, path, sizes = _mapped(stage(rows, "slots"), shards, slots, place=F.col("_place"))
    rows = _with_shard(rows, path, grow_map(rows.sparkSession, path, sizes), "vslot", "next_shard")
    counts = rows.groupBy("shard", "vslot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("vslot").alias("_slot"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "_place")
    numbered = rows.withColumn("k", F.row_number().over(inside) - 1).join(counts, F.col("vslot") == F.col("_slot"))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "next_shard"
    )


def sharded_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """All columns of ``docs`` and the shard of each row, near equal in bytes; a column of that name is replaced."""
    names = [n for n in docs.columns if n != "shard"]
    rows = docs.drop("shard").withColumn("_vslot", virtual_slot(slots)).withColumn("_bytes", row_size())
    return _mapped(rows, shards, slots, "_vslot", "_bytes")[0].select(*[F.col(f"`{n}`") for n in names], "shard")
