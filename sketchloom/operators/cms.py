"""Count-min sketches as a relation of cells, with pluggable estimates.

A sketch is a table ``(row, col, cnt)``; absent cells are zero.  Weights may be negative, so removing is inserting the
negated weight, and sketches merge by addition.  Null keys and null weights are not inserted; a null key's estimate is null.
Inner columns take names that the data does not use; an estimate column that exists already is an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import fresh, unused
from ..hashing import hashes, nth, pair

#: A sketch up to this many cells (8 MB) is one value in the plan that asks it; a larger one is joined cell by cell.
BROADCAST_CELLS = 1 << 20


@dataclass(frozen=True)
class CmsSpec:
    rows: int
    cols: int
    seed: str = ""

    def __post_init__(self):
        if self.rows < 1 or self.cols < 2:
            raise ValueError("a sketch needs a row and two columns at least")

    @staticmethod
    def for_error(epsilon: float, delta: float, seed: str = "") -> CmsSpec:
        return CmsSpec(params.cms_rows(delta), params.cms_cols(epsilon), seed)

    @property
    def confidence(self) -> float:
        """e / cols: the error, as a share of the total weight."""
        return 2.718281828459045 / self.cols

    @property
    def error(self) -> float:
        """1 / e^rows: the chance that an estimate exceeds it."""
        return 2.718281828459045**-self.rows


def cells(key: Column, spec: CmsSpec) -> Column:
    """array<struct<row, col>> of a key."""
    a, b = pair(key, spec.seed)
    return F.transform(hashes(a, b, spec.rows), lambda h, i: F.struct(i.cast("bigint").alias("row"), (h % spec.cols).alias("col")))


def build(df: DataFrame, key: Column, spec: CmsSpec, weight: Column | None = None, group: str | None = None) -> DataFrame:
    """Weights are summed by key before keys are spread over rows, so a hot key costs one row a task."""
    by = [group] if group else []
    w = F.lit(1) if weight is None else weight
    rows = df.where(key.isNotNull() & w.isNotNull()).select(*[F.col(c).alias("_g") for c in by], key.alias("_key"), w.cast("bigint").alias("_w"))
    inner = [c for c in rows.columns if c == "_g"]
    keyed = rows.groupBy(*inner, "_key").agg(F.sum("_w").alias("_w"))
    spread = keyed.select(*inner, "_w", F.explode(cells(F.col("_key"), spec)).alias("c")).select(*inner, "_w", "c.row", "c.col")
    found = spread.groupBy(*inner, "row", "col").agg(F.sum("_w").alias("cnt"))
    return found.withColumnRenamed("_g", group) if group else found


def merge(*sketches: DataFrame) -> DataFrame:
    rows = sketches[0]
    for s in sketches[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy([c for c in rows.columns if c != "cnt"]).agg(F.sum("cnt").alias("cnt"))


def removed(sketch: DataFrame, df: DataFrame, key: Column, spec: CmsSpec, weight: Column | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    return merge(sketch, build(df, key, spec, -w))


#: An estimate: from the array of a key's cells (one for each row), the total weight and the spec to a bigint column.
Strategy = Callable[[Column, Column, CmsSpec], Column]


def count_min(values: Column, total: Column, spec: CmsSpec) -> Column:
    return F.array_min(values)


def count_mean(values: Column, total: Column, spec: CmsSpec) -> Column:
    """Mean over rows, halves away from zero."""
    return F.round(F.aggregate(values, F.lit(0).cast("bigint"), lambda s, v: s + v) / spec.rows).cast("bigint")


def count_median_bias(values: Column, total: Column, spec: CmsSpec) -> Column:
    """Lower median of the cells less their expected noise, at most the least cell."""
    less = F.array_sort(F.transform(values, lambda v: v - F.ceil((total - v) / (spec.cols - 1)).cast("bigint")))
    return F.least(F.array_min(values), F.element_at(less, (spec.rows - 1) // 2 + 1))


STRATEGIES: dict[str, Strategy] = {"min": count_min, "mean": count_mean, "median_bias": count_median_bias}


def total_weight(sketch: DataFrame) -> DataFrame:
    """One row: the sum of all weights, read off the first row of cells."""
    return sketch.where("row = 0").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))


def packed(sketch: DataFrame, spec: CmsSpec) -> DataFrame:
    """One row: all cells in order, zeros included. Only for sketches whose size allows it."""
    every = sketch.sparkSession.range(spec.rows * spec.cols).select(F.col("id").alias("at"))
    full = every.join(sketch.select((F.col("row") * spec.cols + F.col("col")).alias("at"), "cnt"), "at", "left")
    pairs = F.sort_array(F.collect_list(F.struct("at", F.coalesce("cnt", F.lit(0)).alias("cnt"))))
    return full.agg(F.transform(pairs, lambda x: x["cnt"]).alias("grid"))


def estimate(
    keys: DataFrame, key: Column, sketch: DataFrame, spec: CmsSpec, strategies: dict[str, Strategy] | None = None, limit: int = BROADCAST_CELLS
) -> DataFrame:
    """``keys`` with one estimate column for each strategy.

    A sketch has ``rows * cols`` cells, known beforehand: up to ``limit`` they are a scalar subquery, and keys are looked up where they
    lie; beyond, distinct keys meet their cells in a join.
    """
    wanted = strategies or STRATEGIES
    unused(keys, *wanted)
    total = total_weight(sketch).scalar()
    if spec.rows * spec.cols <= limit:
        one, two, values = fresh(keys, "_a", "_b", "_values")
        grid, (a, b) = packed(sketch, spec).scalar(), pair(key, spec.seed)
        cell = lambda i: F.element_at(grid, (nth(F.col(one), F.col(two), i) % spec.cols + i * spec.cols + 1).cast("int"))
        hashed = keys.withColumns({one: a, two: b})
        known = F.col(one).isNotNull()
        found = hashed.select(*[hashed[c] for c in keys.columns], F.when(known, F.array(*[cell(i) for i in range(spec.rows)])).alias(values))
        gone = [values]
    else:
        own, asked, at, values = fresh(keys, "_key", "_asked", "_cell", "_values")
        keyed = keys.withColumn(own, key)
        distinct = keyed.where(F.col(own).isNotNull()).select(F.col(own).alias(asked)).distinct()
        spread = distinct.select(asked, F.explode(cells(F.col(asked), spec)).alias(at))
        met = spread.join(sketch, (spread[at]["row"] == sketch["row"]) & (spread[at]["col"] == sketch["col"]), "left")
        listed = F.sort_array(F.collect_list(F.struct(F.col(at)["row"].alias("row"), F.coalesce("cnt", F.lit(0)).alias("cnt"))))
        answers = met.groupBy(asked).agg(F.transform(listed, lambda x: x["cnt"]).alias(values))
        found = keyed.join(answers, F.col(own) == F.col(asked), "left")
        gone = [own, asked, values]
    # a column first: strategies may use it inside lambdas, where a subquery may not stand
    (every,) = fresh(found, "_total")
    found = found.withColumn(every, total)
    out = {name: F.when(F.col(values).isNotNull(), f(F.col(values), F.col(every), spec)) for name, f in wanted.items()}
    return found.withColumns(out).drop(*gone, every)


def heavy_hitters(df: DataFrame, key: Column, spec: CmsSpec, n: int, name: str = "item") -> DataFrame:
    """The n keys of the highest min estimates, ties by key."""
    keys = df.where(key.isNotNull()).select(key.alias(name)).distinct()
    return estimate(keys, F.col(name), build(df, key, spec), spec, {"estimate": count_min}).orderBy(F.desc("estimate"), name).limit(n)


def clear(sketch: DataFrame) -> DataFrame:
    return sketch.limit(0)


def is_empty(sketch: DataFrame) -> bool:
    """Whether all cells are zero: nothing was inserted, or all of it was removed."""
    return sketch.where("cnt <> 0").isEmpty()
