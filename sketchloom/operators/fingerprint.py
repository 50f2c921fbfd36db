"""Cuckoo and quotient filters as sets of fingerprints.

A cuckoo filter's buckets number a power of two, so an item's two buckets follow from its fingerprint and the smaller of them;
membership is membership of ``(fingerprint, min_bucket)`` in the stored set, whatever the order of insertion and the
displacements.  A quotient filter is the set of ``(quotient, remainder)``.  So inserting is ``distinct``, asking is a semi-join, removing
is an anti-join, and filters merge by union.  Null keys are not inserted; asking for a null gives null.  Inner columns take names
that the data does not use; a verdict column that exists already is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions import fresh, unused
from ..hashing import BITS, half


@dataclass(frozen=True)
class CuckooSpec:
    buckets: int
    fingerprint_bits: int = 8
    entries: int = 4
    seed: str = ""

    def __post_init__(self):
        params.check_fingerprint_bits(self.fingerprint_bits, BITS)
        if self.buckets < 1 or self.buckets & (self.buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        if self.entries < 1:
            raise ValueError("a bucket needs an entry at least")

    @staticmethod
    def for_items(items: int, fingerprint_bits: int = 8, entries: int = 4, seed: str = "") -> CuckooSpec:
        return CuckooSpec(params.cuckoo_buckets(items, entries), fingerprint_bits, entries, seed)

    @staticmethod
    def for_fpp(items: int, fpp: float, entries: int = 4, seed: str = "") -> CuckooSpec:
        return CuckooSpec(params.cuckoo_buckets(items, entries), params.cuckoo_fingerprint_bits(fpp, entries), entries, seed)

    @staticmethod
    def for_width(items: int, fpp: float, fingerprint_bits: int, seed: str = "") -> CuckooSpec:
        entries = params.cuckoo_entries(fpp, fingerprint_bits)
        return CuckooSpec(params.cuckoo_buckets(items, entries), fingerprint_bits, entries, seed)

    @property
    def capacity(self) -> int:
        return self.buckets * self.entries


@dataclass(frozen=True)
class QuotientSpec:
    quotient_bits: int
    remainder_bits: int
    seed: str = ""

    def __post_init__(self):
        if self.quotient_bits < 1 or self.remainder_bits < 1 or self.quotient_bits + self.remainder_bits > BITS:
            raise ValueError(f"both widths must be positive and together at most {BITS}")

    @staticmethod
    def for_fpp(capacity: int, fpp: float, seed: str = "") -> QuotientSpec:
        return QuotientSpec(params.quotient_bits(capacity), params.remainder_bits(fpp), seed)

    @property
    def capacity(self) -> int:
        return 1 << self.quotient_bits


Spec = CuckooSpec | QuotientSpec


def cuckoo_columns(key: Column, spec: CuckooSpec) -> dict[str, Column]:
    low = half(key, 0, spec.seed) % (1 << spec.fingerprint_bits)
    fp = F.when(low == 0, F.lit(1).cast("bigint")).otherwise(low)
    one = half(key, 1, spec.seed) % spec.buckets
    two = one.bitwiseXOR(half(fp.cast("string"), 0, spec.seed) % spec.buckets)
    return {"fingerprint": fp, "min_bucket": F.least(one, two)}


def quotient_columns(key: Column, spec: QuotientSpec) -> dict[str, Column]:
    h = half(key, 0, spec.seed)
    return {"quotient": F.shiftright(h, spec.remainder_bits) % spec.capacity, "remainder": h % (1 << spec.remainder_bits)}


def columns_of(key: Column, spec: Spec) -> dict[str, Column]:
    """The stored pair of a key; null for a null key."""
    made = cuckoo_columns(key, spec) if isinstance(spec, CuckooSpec) else quotient_columns(key, spec)
    return {name: F.when(key.isNotNull(), c) for name, c in made.items()}


def build(df: DataFrame, key: Column, spec: Spec) -> DataFrame:
    return df.where(key.isNotNull()).select(*[c.alias(n) for n, c in columns_of(key, spec).items()]).distinct()


def insert(stored: DataFrame, df: DataFrame, key: Column, spec: Spec) -> DataFrame:
    return stored.unionByName(build(df, key, spec)).distinct()


def remove(stored: DataFrame, df: DataFrame, key: Column, spec: Spec) -> DataFrame:
    """Without the pairs of the given keys; another key with the same pair goes too, as in any such filter."""
    return stored.join(build(df, key, spec), stored.columns, "left_anti")


def _keyed(df: DataFrame, key: Column, stored: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame, list[str]]:
    """``df`` with its keys' pairs, and the stored pairs, under fresh names."""
    made = columns_of(key, spec)
    names = fresh(df, *[f"_{n}" for n in made])
    return df.withColumns(dict(zip(names, made.values(), strict=True))), stored.select(*[F.col(c).alias(n) for c, n in zip(made, names, strict=True)]), names


def with_contains(df: DataFrame, key: Column, stored: DataFrame, spec: Spec, name: str = "found") -> DataFrame:
    """``df`` with a verdict; Spark picks the join by the set's size."""
    unused(df, name)
    keyed, held, pair = _keyed(df, key, stored, spec)
    (hit,) = fresh(keyed, "_hit")
    joined = keyed.join(held.withColumn(hit, F.lit(True)), pair, "left")
    verdict = F.when(F.col(pair[0]).isNotNull(), F.coalesce(hit, F.lit(False)))
    return joined.select(*[joined[c] for c in df.columns], verdict.alias(name))


def contained(df: DataFrame, key: Column, stored: DataFrame, spec: Spec) -> DataFrame:
    keyed, held, pair = _keyed(df, key, stored, spec)
    return keyed.join(held, pair, "left_semi").drop(*pair)


def clear(stored: DataFrame) -> DataFrame:
    return stored.limit(0)


def is_empty(stored: DataFrame) -> bool:
    return stored.isEmpty()


def cuckoo_stats(stored: DataFrame, spec: CuckooSpec) -> DataFrame:
    """stored, buckets, slots, overflow (pairs beyond the capacity), is_empty, is_nearly_full (some pair found no slot), estimated_fpp.

    As a set has no placement, overflow is the least that any placement leaves over.
    """
    f = 2.0**spec.fingerprint_bits
    n = F.col("stored")
    return stored.agg(F.count("*").alias("stored")).select(
        "stored",
        F.lit(spec.buckets).cast("bigint").alias("buckets"),
        F.lit(spec.capacity).cast("bigint").alias("slots"),
        F.greatest(n - spec.capacity, F.lit(0)).cast("bigint").alias("overflow"),
        (n == 0).alias("is_empty"),
        (n > spec.capacity).alias("is_nearly_full"),
        (1 - F.pow(F.lit((f - 2) / (f - 1)), 2.0 * spec.entries * F.least(n, F.lit(spec.capacity)) / spec.capacity)).alias("estimated_fpp"),
    )


def quotient_stats(stored: DataFrame, spec: QuotientSpec) -> DataFrame:
    n = F.col("stored")
    return stored.agg(F.count("*").alias("stored")).select(
        "stored",
        F.lit(spec.capacity).cast("bigint").alias("slots"),
        (n == 0).alias("is_empty"),
        (n > spec.capacity).alias("over_full"),
        (1 - F.exp(-(n / F.lit(float(spec.capacity))) / F.lit(2.0**spec.remainder_bits))).alias("estimated_fpp"),
    )


#: Slots of a block of the layout: one window's rows, about.
BLOCK_SLOTS = 1 << 16
#: Most blocks, whose counts one task carries over.
MOST_BLOCKS = 1 << 20


def quotient_layout(stored: DataFrame, spec: QuotientSpec, blocks: int | None = None) -> DataFrame:
    """Physical slots with their three marks: slot, quotient, remainder, is_occupied, is_continuation, is_shifted.

    In sorted order the kth pair sits at k + max(q_j - j) over j <= k; two turns of the table settle what
    wraps past its end.  Ranks and running maxima are taken inside blocks of quotients (of ``BLOCK_SLOTS`` slots, unless told
    otherwise) and carried over a table of at most ``2 * blocks`` rows, so no task sorts the whole filter.
    """
    size = spec.capacity
    blocks = blocks or min(MOST_BLOCKS, max(16, size // BLOCK_SLOTS))
    turns = stored.select("quotient", "remainder", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    width = max(1, size // blocks)
    turns = turns.withColumn("q", F.col("quotient") + F.col("turn") * size).withColumn("block", F.floor(F.col("q") / width))
    inside = Window.partitionBy("block").orderBy("q", "remainder")
    local = turns.withColumn("k", F.row_number().over(inside) - 1)
    local = local.withColumn("m", F.max(F.col("q") - F.col("k")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sums = local.groupBy("block").agg(F.count("*").alias("n"), F.max("m").alias("most"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = sums.withColumn("carried", F.max(F.col("most") - F.col("first")).over(before)).select("block", "first", "carried")
    k = F.col("first") + F.col("k")
    slot = k + F.greatest(F.col("m") - F.col("first"), F.coalesce("carried", F.lit(-(1 << 62))))
    placed = local.join(F.broadcast(sums), "block").withColumn("_slot", slot).where("turn = 1")
    placed = placed.withColumn("slot", F.col("_slot") % size)
    first = F.row_number().over(Window.partitionBy("quotient").orderBy("remainder")) > 1
    placed = placed.select("slot", "quotient", "remainder", first.alias("is_continuation"), (F.col("slot") != F.col("quotient")).alias("is_shifted"))
    occupied = stored.select(F.col("quotient").alias("slot"), F.lit(True).alias("_occupied")).distinct()
    return placed.join(occupied, "slot", "left").select(
        "slot", "quotient", "remainder", F.coalesce("_occupied", F.lit(False)).alias("is_occupied"), "is_continuation", "is_shifted"
    )
