"""Distinct counting with registers ``(register, rho)`` that merge by ``max`` and roll up over any grouping.

The register is the low p bits of a 48-bit hash; rho is one more than the run of ones above them.  Null keys are not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import fresh
from ..hashing import BITS, half


def register_columns(key: Column, p: int, seed: str = "") -> tuple[Column, Column]:
    h = half(key, 0, seed)
    above = F.shiftright(h, p)
    lowest_zero = (above + 1).bitwiseAND(F.bitwise_not(above))
    return h % (1 << p), F.length(F.bin(lowest_zero)).cast("bigint")


def build(df: DataFrame, key: Column, p: int, group: list[str | Column] | None = None, seed: str = "") -> DataFrame:
    register, rho = register_columns(key, p, seed)
    names = group or []
    rows = df.where(key.isNotNull()).select(*names, register.alias("register"), rho.alias("rho"))
    return rows.groupBy(*[c for c in rows.columns if c != "rho"]).agg(F.max("rho").alias("rho"))


def merge(*sketches: DataFrame) -> DataFrame:
    rows = sketches[0]
    for s in sketches[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy([c for c in rows.columns if c != "rho"]).agg(F.max("rho").alias("rho"))


def estimate(registers: DataFrame, p: int, group: list[str] | None = None) -> DataFrame:
    """``group`` columns and ``estimate``, rounded to six places; without groups an empty sketch counts 0.

    The harmonic sum is taken over exact integers, 2^(49 - p - rho), and divided once.
    """
    names, m, top = group or [], 1 << p, BITS + 1 - p
    term = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(top) - F.col("rho")).cast("int"))
    held, total = fresh(registers, "_set", "_sum")
    sums = registers.groupBy(*names).agg(F.count("*").alias(held), F.coalesce(F.sum(term), F.lit(0)).alias(total))
    zeros = F.lit(m) - F.col(held)
    scale = params.hll_alpha(p) * m * m * 2.0**top
    raw = F.lit(scale) / (F.col(total) + zeros * F.lit(1 << top)).cast("double")
    linear = F.lit(float(m)) * F.log(F.lit(float(m)) / zeros.cast("double"))
    value = F.when((raw <= 2.5 * m) & (zeros > 0), linear).otherwise(raw)
    return sums.select(*names, F.round(value, 6).alias("estimate"))


def count_distinct(df: DataFrame, key: Column, error: float = 0.02, group: list[str] | None = None) -> DataFrame:
    p = params.hll_precision(error)
    return estimate(build(df, key, p, group), p, group)


def rollup(registers: DataFrame, p: int, levels: list[str]) -> DataFrame:
    """Estimates at every level of a rollup, from one build and one aggregate over all levels; ``level`` counts the columns rolled up."""
    sets = [[*levels[: len(levels) - i], "register"] for i in range(len(levels) + 1)]
    merged = registers.groupingSets(sets, *levels, "register").agg(F.max("rho").alias("rho"), F.grouping_id().alias("_gid"))
    # the lowest bit is the register's, which is never rolled up; a level sets a bit for each column above it
    level = F.bit_count(F.shiftright("_gid", 1)).alias("level")
    return estimate(merged.select(*levels, level, "register", "rho"), p, [*levels, "level"])


def clear(registers: DataFrame) -> DataFrame:
    return registers.limit(0)


def is_empty(registers: DataFrame) -> bool:
    """Whether nothing was counted."""
    return registers.isEmpty()


def fast_count(df: DataFrame, key: Column, group: list[str] | None = None) -> DataFrame:
    """The built-in sketch, with its own hash: quickest, but without registers to look at or check against."""
    return df.groupBy(*(group or [])).agg(F.hll_sketch_estimate(F.hll_sketch_agg(key)).alias("estimate"))
