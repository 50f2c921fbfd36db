"""Bloom filters, plain and partitioned: build, probe, statistics, union, intersection.

A filter is a table of 32-bit words ``(word_idx, word)``, with a group column in front where filters are built by group;
absent words are zero.  Building is one partial and one final ``bit_or``; filters of the same spec merge by ``bit_or``.
Null keys are not inserted, and probing a null gives null.  Inner columns take names that the data does not use; a verdict
column that exists already is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import WORD, bit_of, fresh, has_bit, popcount, unused, word_of
from ..hashing import hashes, nth, pair

#: A filter up to this size (4 MB of words) is one value in the probing plan; a larger one is joined word by word.
BROADCAST_BITS = 1 << 24


@dataclass(frozen=True)
class BloomSpec:
    """``bits`` is the whole length; a partitioned filter gives each hash ``bits / hashes`` bits of its own."""

    bits: int
    hashes: int
    partitioned: bool = False
    seed: str = ""
    #: Where the hashes come from: ``sql`` or ``xx`` (see ``hashing``); filters of different providers do not merge.
    provider: str = "sql"

    @staticmethod
    def for_items(items: int, fpp: float, seed: str = "") -> BloomSpec:
        bits = params.bloom_bits(items, fpp)
        return BloomSpec(bits, params.bloom_hashes(bits, items), seed=seed)

    @staticmethod
    def for_bits_and_items(bits: int, items: int, seed: str = "") -> BloomSpec:
        return BloomSpec(bits, params.bloom_hashes(bits, items), seed=seed)

    @staticmethod
    def for_bits_and_fpp(bits: int, fpp: float, seed: str = "") -> BloomSpec:
        return BloomSpec(bits, params.bloom_hashes(bits, params.bloom_items(bits, fpp)), seed=seed)

    @staticmethod
    def partitioned_for_items(items: int, fpp: float, seed: str = "") -> BloomSpec:
        k = params.partition_hashes(fpp)
        return BloomSpec(params.partition_bits(items, fpp) * k, k, True, seed)

    @staticmethod
    def partitioned_for_bits(bits_each: int, fpp: float, seed: str = "") -> BloomSpec:
        k = params.partition_hashes(fpp)
        return BloomSpec(bits_each * k, k, True, seed)

    @property
    def partition_bits(self) -> int:
        return self.bits // self.hashes if self.partitioned else self.bits

    @property
    def words(self) -> int:
        return -(-self.bits // WORD)

    @property
    def is_empty(self) -> bool:
        """No bits at all; whether items were inserted is ``stats(...).has_items``."""
        return self.bits == 0


def positions(key: Column, spec: BloomSpec) -> Column:
    """array<bigint> of the key's bit positions."""
    a, b = pair(key, spec.seed, spec.provider)
    every = hashes(a, b, spec.hashes)
    if spec.partitioned:
        return F.transform(every, lambda h, i: h % spec.partition_bits + i * spec.partition_bits)
    return F.transform(every, lambda h: h % spec.bits)


def position(a: Column, b: Column, i: int, spec: BloomSpec) -> Column:
    """The ith bit position of a key whose hash pair is (a, b)."""
    at = nth(a, b, i) % spec.partition_bits
    return at + i * spec.partition_bits if spec.partitioned else at


def build(df: DataFrame, key: Column, spec: BloomSpec, group: str | None = None) -> DataFrame:
    """(word_idx, word), with ``group`` in front where a filter is built for each of its values."""
    by = [F.col(group).alias("_g")] if group else []
    rows = df.where(key.isNotNull()).select(*by, F.explode(positions(key, spec)).alias("pos"))
    words = rows.groupBy(*["_g" for _ in by], word_of(F.col("pos")).alias("word_idx")).agg(F.bit_or(bit_of(F.col("pos"))).alias("word"))
    return words.withColumnRenamed("_g", group) if group else words


def union(*filters: DataFrame) -> DataFrame:
    rows = filters[0]
    for f in filters[1:]:
        rows = rows.unionByName(f)
    return rows.groupBy([c for c in rows.columns if c != "word"]).agg(F.bit_or("word").alias("word"))


def intersect(one: DataFrame, two: DataFrame) -> DataFrame:
    both = one.join(two.withColumnRenamed("word", "_other"), [c for c in one.columns if c != "word"])
    return both.withColumn("word", F.col("word").bitwiseAND(F.col("_other"))).drop("_other").where("word <> 0")


def dense(words: DataFrame, spec: BloomSpec) -> DataFrame:
    """One row: all words in order, zeros included. Only for filters whose length allows it."""
    spark = words.sparkSession
    every = spark.range(spec.words).select(F.col("id").alias("word_idx")).join(words, "word_idx", "left")
    pairs = F.sort_array(F.collect_list(F.struct("word_idx", F.coalesce("word", F.lit(0)).cast("bigint").alias("word"))))
    return every.agg(F.transform(pairs, lambda x: x["word"]).alias("words"))


def with_contains(df: DataFrame, key: Column, words: DataFrame, spec: BloomSpec, name: str = "found", limit: int = BROADCAST_BITS) -> DataFrame:
    """``df`` with a verdict column; the filter's length, known beforehand, decides between one value and a join.

    As one value the filter is a scalar subquery: rows are tested where they lie, each by its own bits, in generated code.
    Filters on other columns belong before the probe; they are not pushed through it.
    """
    unused(df, name)
    if spec.bits <= limit:
        one, two, held, here = fresh(df, "_a", "_b", "_held", "_here")
        a, b = pair(key, spec.seed, spec.provider)
        # the task's number stands in the verdict only to keep a filter on it from being pushed below this projection, where the
        # hashes would be computed again for every bit
        hashed = df.withColumns({one: a, two: b, held: dense(words, spec).scalar(), here: F.spark_partition_id()})
        verdict = F.col(here) >= 0
        for i in range(spec.hashes):
            verdict = verdict & has_bit(F.col(held), position(F.col(one), F.col(two), i, spec))
        return hashed.select(*[hashed[c] for c in df.columns], F.when(F.col(one).isNotNull(), verdict).alias(name))
    own, asked_key, at, idx = fresh(df, "_key", "_asked", "_pos", "_word")
    keyed = df.withColumn(own, key)
    distinct = keyed.where(F.col(own).isNotNull()).select(F.col(own).alias(asked_key)).distinct()
    asked = distinct.select(asked_key, F.explode(positions(F.col(asked_key), spec)).alias(at)).withColumn(idx, word_of(F.col(at)))
    hit = F.coalesce(F.col("word"), F.lit(0)).bitwiseAND(bit_of(F.col(at))) != 0
    answers = asked.join(words, F.col(idx) == words["word_idx"], "left").groupBy(asked_key).agg(F.bool_and(hit).alias(name))
    return keyed.join(answers, F.col(own) == F.col(asked_key), "left").drop(own, asked_key)


def contained(df: DataFrame, key: Column, words: DataFrame, spec: BloomSpec) -> DataFrame:
    """Approximate semi-join: the rows whose key the filter may hold."""
    (name,) = fresh(df, "_found")
    return with_contains(df, key, words, spec, name).where(F.col(name)).drop(name)


def reduced_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str, spec: BloomSpec) -> DataFrame:
    """Exact inner join whose big side is thinned by a filter over the small side's keys before it is shuffled.

    It pays where the big side would be shuffled and most of its rows find no partner; a small side that is broadcast needs no filter.
    """
    # the filter never leaves this plan, so its hashes may be the quickest; keys of one type are hashed as they are
    spec = replace(spec, provider="xx")
    same = big.schema[big_key].dataType == small.schema[small_key].dataType
    own, other = (F.col(c) if same else F.col(c).cast("string") for c in (big_key, small_key))
    thin = contained(big, own, build(small, other, spec), spec)
    return thin.join(small, thin[big_key] == small[small_key])


def stats(words: DataFrame, spec: BloomSpec, group: str | None = None) -> DataFrame:
    """bits, hashes, ones, zeros, estimated_fpp, has_items."""
    by = [group] if group else []
    counted = words.groupBy(*by).agg(F.coalesce(F.sum(popcount(F.col("word"))), F.lit(0)).cast("bigint").alias("ones"))
    return counted.select(
        *by,
        F.lit(spec.bits).cast("bigint").alias("bits"),
        F.lit(spec.hashes).cast("bigint").alias("hashes"),
        "ones",
        (F.lit(spec.bits).cast("bigint") - F.col("ones")).alias("zeros"),
        F.pow(F.col("ones") / F.lit(float(spec.bits)), F.lit(float(spec.hashes))).alias("estimated_fpp"),
        (F.col("ones") > 0).alias("has_items"),
    )


def clear(words: DataFrame) -> DataFrame:
    return words.limit(0)


def is_empty(words: DataFrame) -> bool:
    """Whether nothing was inserted."""
    return words.where("word <> 0").isEmpty()
