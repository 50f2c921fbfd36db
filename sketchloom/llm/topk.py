"""Exact top-k inner products by vector-approximation files.

Every vector is quantised once, one byte a component on a scale of its own (its least component and a shift), and these cells are
written as a file of their own, a fraction of the vectors' size.  The search scans that file only: a cell bounds the
score of its vector from below and above, in whole numbers.  Of each block of cells a query keeps the vectors whose upper bound reaches
the kth lower bound.  Exact vectors are then read in the order of their upper bounds: first the ``FIRST * k`` best, whose
kth exact score is a floor, then those whose bound reaches the floor.  No other vector can matter, so the result is certain.

The queries are a stated set against all rows, so both sides are dealt in blocks of bounded bytes; each
(vector block, query block) pair is one task, to which cells travel, never vectors.

Vectors whose integers are so large that sums of products could leave exact floating point are *wild*: they, as queries and as
candidates, are compared in whole numbers without bounds.

Defined results: vectors that are null, or that hold a null or a non-finite component (or one whose integer is
not finite), and rows with a null id take no part; a query meets every other row of its own length, rows that repeat its id
included; ties go to the smaller id; fewer than k candidates give all; scores beyond a long
are held to its range; an empty table gives an empty result; only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_checked, per_batch, tune

SCALE = 1024
#: Bytes of cells and of queries (8 a component) of one task, and the least number of vector blocks.
BLOCK_BYTES, QUERY_BYTES, LEAST_BLOCKS = 32 << 20, 32 << 20, 64
#: Bytes of an inner step's products, and its queries.
STEP_BYTES, STEP_QUERIES = 16 << 20, 256
#: So many times k vectors are read before there is a floor.
FIRST = 2
LONG = 2**63 - 1


def to_integers(flat: np.ndarray) -> np.ndarray:
    """floor(1024 x), as int64 where it fits, else Python integers."""
    v = np.floor(flat.astype(np.float64) * SCALE)
    return v.astype(np.int64) if not len(v) or np.abs(v).max() < 2**62 else np.array([int(x) for x in v], object)


def quantise(vectors: DataFrame) -> DataFrame:
    """The cells of tame ``vectors`` (uid, vec, ...): uid, size, low, shift, cells.

    A component's integer lies in low + (cell << shift) .. low + (cell << shift) + 2^shift - 1.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sizes, lows, shifts, cells = [], [], [], []
        for v in b.column(1):
            i = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64)
            low, high = (int(i.min()), int(i.max())) if len(i) else (0, 0)
            shift = max(0, (high - low).bit_length() - 8)
            sizes.append(len(i))
            lows.append(low)
            shifts.append(shift)
            cells.append(((i - low) >> shift).astype(np.uint8).tobytes())
        columns = [b.column(0), pa.array(sizes, pa.int32()), pa.array(lows, pa.int64()), pa.array(shifts, pa.int32()), pa.array(cells, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["uid", "size", "low", "shift", "cells"])

    return per_batch(vectors.select("uid", "vec"), run, "uid long, size int, low long, shift int, cells binary")


class Cells:
    """The cells of a block's vectors of one length, and the bounds that they give."""

    def __init__(self, uid: np.ndarray, low: np.ndarray, shift: np.ndarray, cells: np.ndarray):
        self.uid, self.low, self.unit, self.cells = uid, low.astype(np.float64), np.ldexp(1.0, shift), cells

    def bounds(self, q: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries, vectors) of the scores of vectors a to b; whole numbers."""
        least = (q @ self.cells[a:b].astype(np.float64).T) * self.unit[a:b] + q.sum(axis=1)[:, None] * self.low[a:b]
        width = self.unit[a:b] - 1
        return least + np.minimum(q, 0).sum(axis=1)[:, None] * width, least + np.maximum(q, 0).sum(axis=1)[:, None] * width


def scan(block: Cells, quid: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (uids, upper bounds) of the vectors that may be among its k best of the block, its own row left out."""
    size = max(queries.shape[1], STEP_QUERIES, 1)
    step, q, out = max(1, STEP_BYTES // (8 * size)), queries.astype(np.float64), []
    for s in range(0, len(q), STEP_QUERIES):
        part, uids = q[s : s + STEP_QUERIES], quid[s : s + STEP_QUERIES]
        lows = [np.empty(0)] * len(part)  # the k highest lower bounds so far
        held: list[list] = [[] for _ in part]
        for a in range(0, len(block.uid), step):
            b = min(a + step, len(block.uid))
            lower, upper = block.bounds(part, a, b)
            for i in range(len(part)):
                others = block.uid[a:b] != uids[i]
                floor = lows[i].min() if len(lows[i]) == k else -np.inf
                more = lower[i][others & (lower[i] > floor)]
                if len(more):
                    every = np.concatenate([lows[i], more])
                    lows[i] = np.partition(every, len(every) - k)[-k:] if len(every) > k else every
                    floor = lows[i].min() if len(lows[i]) == k else -np.inf
                keep = np.flatnonzero(others & (upper[i] >= floor))
                held[i].append((block.uid[a:b][keep], upper[i][keep]))
        for low, parts in zip(lows, held, strict=True):
            ids, upper = (np.concatenate([p[j] for p in parts]) if parts else np.empty(0) for j in (0, 1))
            keep = upper >= (low.min() if len(low) == k else -np.inf)
            out.append((ids[keep], upper[keep]))
    return out


def plain(block: tuple, asked: tuple, k: int) -> list[tuple[list, list]]:
    """For each query (ids, scores) of its k best of the block in whole numbers, held to a long's range; blocks are (uid, id, integers)."""
    exact, out = [[int(x) for x in row] for row in block[2]], []
    for u, q in zip(asked[0].tolist(), asked[2], strict=True):
        own = [int(x) for x in q]
        scores = [max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(own, row, strict=True)))) for row in exact]
        order = sorted((-s, i) for s, i, v in zip(scores, block[1].tolist(), block[0].tolist(), strict=True) if v != u)[:k]
        out.append(([i for _, i in order], [-s for s, _ in order]))
    return out


def _by_size(t: pa.Table) -> dict[int, pa.Table]:
    sizes = t.column("size").to_numpy()
    return {int(d): t.filter(pa.array(sizes == d)) for d in np.unique(sizes)}


def _integers(t: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uid, id, integers of vectors of one length."""
    flat = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return t.column("uid").to_numpy(), t.column("id").to_numpy(), to_integers(flat).reshape(t.num_rows, size)


def _cells(t: pa.Table, size: int) -> Cells:
    made = np.frombuffer(b"".join(t.column("cells").to_pylist()), np.uint8).reshape(t.num_rows, size)
    return Cells(t.column("uid").to_numpy(), t.column("low").to_numpy(), t.column("shift").to_numpy(), made)


def in_blocks(vectors: DataFrame, queries: DataFrame, per_component: int, fn, schema: str) -> DataFrame:
    """Apply ``fn(vectors, queries, length)`` to the Arrow tables of each pair of blocks and length; blocks are cut by bytes, not rows. All columns of ``schema`` are long."""
    total, asked = (df.agg(F.coalesce(F.sum((F.col("size") + 32).cast("long")), F.lit(0))).first()[0] for df in (vectors, queries))
    blocks, others = max(LEAST_BLOCKS, -(-total * per_component // BLOCK_BYTES)), max(1, -(-8 * asked // QUERY_BYTES))
    nothing = pa.table({f.split()[0]: pa.array([], pa.int64()) for f in schema.split(", ")})

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int):
        block = F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int").alias(own)
        return df.select(block, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), *df.columns).groupBy("vb", "qb")

    def run(mine: pa.Table, questions: pa.Table) -> pa.Table:
        have = _by_size(mine) if mine.num_rows and questions.num_rows else {}
        made = [fn(have[d], t, d) for d, t in (_by_size(questions) if have else {}).items() if d in have]
        return pa.concat_tables(made) if made else nothing

    return dealt(vectors, "vb", blocks, "qb", others).cogroup(dealt(queries, "qb", others, "vb", blocks)).applyInArrow(run, schema)


def _flat(lists: list) -> np.ndarray:
    return np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.empty(0, np.int64)


def read_vectors(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """row, query_id, vec_id, score: one row for each exact vector that a query reads; its k best are among them.  ``row`` tells queries of one id apart."""
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark, "topk")
    vec = F.col("vec")
    # a comparison that null and NaN fail too
    sound = F.forall(vec, lambda x: F.coalesce((F.abs(x.cast("double") * SCALE) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("vec")).where(F.col("id").isNotNull() & vec.isNotNull() & sound)
    rows = scratch.keep(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "vec", F.size("vec").alias("size"), F.coalesce(is_query, F.lit(False)).alias("q")))
    largest = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))) * SCALE
    # products of two tame vectors, and of their bounds, sum up exactly in floating point
    wild = F.coalesce(largest + 1 > F.sqrt(F.lit(2.0**50) / F.greatest("size", F.lit(1))), F.lit(False))
    tame, odd = rows.where(~wild), rows.where(wild)
    cells = scratch.keep(quantise(tame))
    queries = rows.where("q").select("uid", "id", "vec", "size")

    def bound(mine: pa.Table, asked: pa.Table, size: int) -> pa.Table:
        quid, _, q = _integers(asked, size)
        found = scan(_cells(mine, size), quid, q, k)
        uid, upper = (_flat([f[j] for f in found]) for j in (0, 1))
        return pa.table({"row": np.repeat(quid, [len(f[0]) for f in found]), "uid": uid, "upper": upper})

    ask = queries.where(~wild)
    found = in_blocks(cells, ask, 1, bound, "row long, uid long, upper long")
    order = Window.partitionBy("row").orderBy(F.desc("upper"), "uid")
    ranked = scratch.keep(found.withColumn("place", F.row_number().over(order)))

    def exact(pairs: DataFrame) -> DataFrame:
        """row, query_id, vec_id, score of pairs (row, uid) of tame vectors."""
        whole = lambda v: F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
        read = join_checked(rows.select("uid", F.col("id").alias("vec_id"), "vec"), pairs.select("row", "uid"), ["uid"], "inner")
        both = read.join(ask.select(F.col("uid").alias("row"), F.col("id").alias("query_id"), F.col("vec").alias("asked")), "row")
        score = F.aggregate(F.zip_with(whole(F.col("vec")), whole(F.col("asked")), lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
        return both.select("row", "query_id", "vec_id", score.alias("score"))

    first = scratch.keep(exact(scratch.keep(ranked.where(F.col("place") <= FIRST * k))))
    best = Window.partitionBy("row").orderBy(F.desc("score"))
    floors = scratch.keep(first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("row", F.col("score").alias("floor")))
    rest = join_checked(ranked.where(F.col("place") > FIRST * k), floors, ["row"], "inner").where("upper >= floor")
    scored = first.unionByName(exact(scratch.keep(rest)))

    if odd.isEmpty():
        return scored

    def compare(mine: pa.Table, asked: pa.Table, size: int) -> pa.Table:
        quid, qid, q = _integers(asked, size)
        found = plain(_integers(mine, size), (quid, qid, q), k)
        n = [len(f[0]) for f in found]
        return pa.table({"row": np.repeat(quid, n), "query_id": np.repeat(qid, n), "vec_id": _flat([f[0] for f in found]), "score": _flat([f[1] for f in found])})

    schema = "row long, query_id long, vec_id long, score long"
    columns = ["uid", "id", "vec", "size"]
    against_all = in_blocks(rows.select(columns), queries.where(wild), 8, compare, schema)
    return scored.unionByName(in_blocks(odd.select(columns), ask, 8, compare, schema)).unionByName(against_all)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score; ``is_query`` is a condition on column ``id``."""
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    read = read_vectors(vectors, is_query, k, key, vector)
    return read.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
