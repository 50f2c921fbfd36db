"""Signatures and fingerprints of many texts at once: the values of single texts, made once, in bounded batches."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sketchloom.operators import similarity


def hashed_once(spark, use) -> tuple[list, int]:
    """The rows of ``use`` of hashed documents, and how many texts were read for them."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        read.add(1)
        return t

    r = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(r.choice("abcdefgh") for _ in range(30))) for i in range(200)], "doc_id long, text string")
    rows = use(similarity.sim_hashes(docs.withColumn("text", seen.asNondeterministic()("text")), "doc_id", "text", 3)).collect()
    return rows, read.value


def test_neighbours_hash_each_text_once(spark):
    def pairs(s):
        s = similarity.dealt(s, "doc_id")
        return s.select(F.col("doc_id").alias("a"), F.col("sim_hash").alias("x")).join(s.select(F.col("doc_id").alias("b"), F.col("sim_hash").alias("y")), F.col("a") + 1 == F.col("b"))

    rows, read = hashed_once(spark, pairs)
    assert len(rows) == 199 and read == 200


def test_candidates_hash_each_text_once(spark):
    assert hashed_once(spark, lambda s: similarity.similar_candidates(s, "doc_id", 3))[1] == 200


@pytest.mark.parametrize("block_bits", [1, 3, 10])
@pytest.mark.parametrize("window", [2, 3, 6])
def test_candidates_across_blocks(spark, window, block_bits):
    r = random.Random(window)
    values = [(i, r.choice([0, (1 << 48) - 1, r.getrandbits(48), r.getrandbits(48) & 0xFF])) for i in range(60)]
    want = set()
    for rot in range(48):
        turned = sorted((((v << rot) | (v >> (48 - rot))) & ((1 << 48) - 1), i) for i, v in values)
        want |= {tuple(sorted((turned[p][1], turned[q][1]))) for p in range(60) for q in range(p + 1, min(60, p + window))}
    df = spark.createDataFrame(values, "doc_id long, sim_hash long")
    assert {tuple(r) for r in similarity.similar_candidates(df, "doc_id", window, block_bits).collect()} == want


@pytest.mark.parametrize("width", [1, 2, 3])
@pytest.mark.parametrize("seed", ["", "s"])
def test_columns_give_what_single_texts_give(monkeypatch, width, seed):
    r = random.Random(3)
    texts = [None, "", "a", " ", "a b c", "a  b", "x y " * 600, *["".join(r.choice("ab é漢\n") for _ in range(r.randrange(300))) for _ in range(60)], None, "é" * 200 + " b c " + "q" * 90]
    for column in (pa.array(texts), pa.array(["zz", *texts]).slice(1), pa.array(texts, pa.large_string())):
        for at_once in (1 << 17, 500):
            monkeypatch.setattr(similarity, "WINDOWS", at_once)
            w = similarity.Windows(column, width)
            least, prints = similarity.column_minima(w, 5, seed), similarity.column_fingerprints(w, seed)
            for i, t in enumerate(texts):
                a, b = similarity.window_pairs(t, width, seed, "sql")
                assert len(a) == w.counts[i]
                if len(a):
                    assert least[i].tolist() == similarity.minima(a, b, 5).tolist() and prints[i] == similarity.fingerprint(a, 48)


def test_pieces_are_bounded_and_whole():
    sizes = [10, 0, 400_000, 700_000, 3_000_000, 5, None, 900_000, 200_000]
    texts = pa.array([None if n is None else "x" * n for n in sizes])
    parts = list(similarity._pieces(pa.RecordBatch.from_arrays([pa.array(range(9)), texts], names=["i", "t"])))
    assert np.concatenate([p.column(0).to_numpy() for p in parts]).tolist() == list(range(9))
    assert all(p.num_rows == 1 or sum(len(t.as_py() or "") for t in p.column(1)) <= similarity.TEXT_BYTES for p in parts)


def held_rows(spark, make) -> int:
    """Rows of a batch that a worker gets after ``make`` has given its table."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    make(spark.range(3).selectExpr("id AS doc_id", "'a b c d' AS text")).collect()
    return int(spark.conf.get(name))


def test_signatures_get_small_batches(spark):
    assert held_rows(spark, lambda docs: similarity.min_hashes(docs, "doc_id", "text", 3, 4)) <= 1_000


def test_shingle_counts_get_small_batches(spark):
    assert held_rows(spark, lambda docs: similarity.shingle_counts(docs, "doc_id", "text", 3)) <= 1_000
