"""Consistent-hash sharding with virtual nodes and bounded loads.

Every shard owns many points (virtual nodes) on a ring; a document's key hash is a place on
the ring, and the next point clockwise is its home.  Loads are bounded: a shard that holds its
capacity takes no more, and what overflows continues clockwise to the next shard with room.
With ``slack`` 0 the capacities are the floor or ceiling of the mean, so counts differ by one at
most; with more slack fewer documents move when a shard is added.

The ring has a fixed number of slots, so the counts that the walk round the ring needs are a
table of constant size, whatever the input; ranks inside a slot come from a window over that slot.  A row's place
follows from its key, CRC and size, so rows that share a key (or have none) spread over the ring.  Full copies are
one row with a count up to the end, where each gets its own place, so a third of all rows may be copies of one.

Defined results: null texts have size 1 and CRC 0; null and repeated ids are ordinary rows (full copies, equal
in key, CRC and size, are interchangeable); an empty table gives an empty result; only the key and text columns are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

RING_BITS = 14
VIRTUAL_NODES = 128
#: Copies that one task spells out at a time.
COPIES = 65_536
#: Rows of a file of a written shard.
FILE_ROWS = 1_000_000


def ring_points(shards: int, virtual_nodes: int = VIRTUAL_NODES, bits: int = RING_BITS) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node in clockwise order; a shard's points never depend on the others."""
    points = []
    for s in range(shards):
        for v in range(virtual_nodes):
            h = hashlib.sha256(f"shard {s} node {v}".encode()).digest()
            points.append((int.from_bytes(h[:8], "big") >> (64 - bits), h[8:16], s))
    return [(p, s) for p, _, s in sorted(points)]


def capacities(total: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [-int(-total * (1 + slack) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, bits: int = RING_BITS) -> list[tuple[int, int, int, int, int]]:
    """Pieces (ring slot, first rank, end rank, shard, first place in the shard) in ring order."""
    points = ring_points(shards, virtual_nodes, bits)
    places = [p for p, _ in points]
    room, taken, out = capacities(sum(counts.values()), shards, slack), [0] * shards, []
    for slot in sorted(counts):
        left, rank, at = counts[slot], 0, bisect_left(places, slot)
        while left:
            s = points[at % len(points)][1]
            if take := min(left, room[s]):
                out.append((slot, rank, rank + take, s, taken[s]))
                room[s] -= take
                taken[s] += take
                rank += take
                left -= take
            at += 1
    return out


def assign_shards(docs: DataFrame, shards: int = 16, slack: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless within the shard); texts are never shuffled."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "shards")
    body = F.col("_text")
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("_text")).select(
        "doc_id",
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n")).withColumn("_hash", F.xxhash64("doc_id", "size", "text_crc32"))
    rows = scratch.keep(rows.withColumn("_ring", F.shiftrightunsigned("_hash", 64 - RING_BITS).cast("int")))
    # at most 2^RING_BITS rows, whatever the input
    found = rows.groupBy("_ring").agg(F.sum("_n").alias("n"), F.max("_n").alias("most")).collect()
    pieces = spark.createDataFrame(walk({r[0]: r[1] for r in found}, shards, slack), "_ring int, _from long, _to long, shard int, _base long")
    within = Window.partitionBy("_ring").orderBy("_hash", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_end", F.sum("_n").over(within)).withColumn("_rank", F.col("_end") - F.col("_n"))
    # a row's copies lie in the pieces of its slot that its ranks reach; bounded by the ring's slots and the virtual nodes
    placed = ranked.join(F.broadcast(pieces), "_ring").where((F.col("_rank") < F.col("_to")) & (F.col("_end") > F.col("_from")))
    first, end = F.greatest("_rank", "_from"), F.least("_end", "_to")
    placed = placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_base") + first - F.col("_from")).alias("slot"), (end - first).alias("_n"))
    if max((r["most"] for r in found), default=1) > 1:
        last = F.col("slot") + F.col("_n") - 1
        chunks = placed.select("*", last.alias("_last"), F.explode(F.sequence("slot", last, F.lit(COPIES).cast("long"))).alias("_at"))
        chunks = chunks.repartition(F.xxhash64("shard", "_at"))
        placed = chunks.withColumn("slot", F.explode(F.sequence("_at", F.least(F.col("_at") + COPIES - 1, F.col("_last")))))
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(assigned: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """One folder per shard, rows in slot order, files of ``file_rows`` rows at most; a shard's files are different tasks' work, so none writes it alone.

    An empty table gives no folders.
    """
    dealt = assigned.withColumn("_part", F.floor(F.col("slot") / file_rows)).repartition("shard", "_part").sortWithinPartitions("shard", "slot").drop("_part")
    dealt.write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)
