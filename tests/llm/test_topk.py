from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sketchloom.llm import topk
from sketchloom.llm.queries import op2_exact_topk, oracle_sql

from ..conftest import rows_of
from .helpers import SMALL


def brute(rows, every, k=10):
    out = set()
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for n, (i, q) in enumerate(good):
        if i % every == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for m, (j, v) in enumerate(good) if m != n and len(v) == len(q))
            out |= {(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])}
    return sorted(out)


def test_against_sql(spark, duck):
    df = op2_exact_topk(spark, SMALL)
    found = duck.execute(oracle_sql()["op2_exact_topk"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in found.description], found.fetchall())


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 8]) for i in range(300)]
    rows += [(400, None), (401, [None] * 5), (402, [float("nan")] * 5), (403, [float("inf")] * 5), (404, [1.0, 2.0]), (500, [2.0, 1.0]), (None, [1.0] * 5), (600, []), (601, [])]
    rows += [(700, [0.5] * 5)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "q": F.lit(0)})
    got = sorted(set(map(tuple, topk.top_k(df, F.col("id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())))
    assert got == brute(rows, 50)
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_huge_components_use_whole_numbers(spark):
    rows = [(i, [float(10 ** (i % 12)), 1e9, -3.5]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(df, F.col("id") % 5 == 0, 3).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == set(brute(rows, 5, 3))


def test_bounds_hold_the_scores():
    """Whole numbers between which every score lies, with each vector on its own scale."""
    rng = np.random.default_rng(4)
    exact = (rng.normal(0, 1, (200, 16)) * 10.0 ** rng.integers(0, 4, (200, 1))).astype(np.int64)
    low = exact.min(axis=1)
    shift = np.array([max(0, int(x).bit_length() - 8) for x in exact.max(axis=1) - low])
    cells = topk.Cells(np.arange(200), low, shift, ((exact - low[:, None]) >> shift[:, None]).astype(np.uint8))
    q = rng.integers(-3000, 3000, (50, 16))
    lower, upper = cells.bounds(q.astype(np.float64), 0, 200)
    score = q @ exact.T
    assert (lower <= score).all() and (score <= upper).all() and (lower == np.floor(lower)).all()


def test_few_vectors_are_read(spark):
    """Bounds from the cells spare most exact vectors, and what they spare changes nothing."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 32)]) for i in range(2_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", "embedding")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    read = topk.read_vectors(df, F.col("id") % 100 == 0).groupBy("query_id").count().collect()
    assert len(read) == 20 and max(r["count"] for r in read) < 200
    assert sorted(map(tuple, topk.top_k(df, F.col("id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 100)


def test_many_blocks_of_both_sides(spark, monkeypatch):
    """Blocks and steps of a few bytes: many query blocks, many vector blocks, lengths that mix, wild vectors among tame ones."""
    for name, n in (("BLOCK_BYTES", 300), ("QUERY_BYTES", 900), ("LEAST_BLOCKS", 3), ("STEP_BYTES", 256), ("STEP_QUERIES", 4), ("FIRST", 1)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-40, 41, 3 + i % 2) / 7]) for i in range(240)]
    rows += [(1_000 + i, [1e9 * i, -2.5e12, 3.0]) for i in range(0, 20, 5)] + [(2_000, [0.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("id") % 5 == 0, 4).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(rows, 5, 4)
