from __future__ import annotations

import random

import numpy as np

from sketchloom.llm import neardup
from sketchloom.llm.common import Scratch
from sketchloom.llm.components import connected_components
from sketchloom.llm.queries import op6_minhash_neardup, oracle_sql

from ..conftest import rows_of
from .helpers import SMALL, extra, odd_documents, tuples

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = (text or "").translate(LOW).encode().split()
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent=85):
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            m = len(sets[a] & sets[b])
            if m and 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(sets[d]), find(d), find(d) == d) for d in ids), key=repr)


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert tuples(op6_minhash_neardup(spark, SMALL), "doc_id", "n_shingles", "component_id", "kept") == brute(rows)


def near_copies(n=120, seed=3):
    """Groups around the threshold, a hot group of near copies, and many texts that share a long passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, passage = [], [word() for _ in range(60)]
    hot = [word() for _ in range(90)]
    for i in range(n):
        if i % 3 == 0:
            t = hot[:]
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = word()
        elif i % 3 == 1:
            t = passage + [word() for _ in range(r.randint(2, 40))]
        else:
            t = r.choice(rows)[1].split() if rows else [word() for _ in range(50)]
            if r.random() < 0.6:
                t[r.randrange(len(t))] = word().upper()
        rows.append((1000 - i, " ".join(t)))
    return rows + [(5000, "A b"), (5001, "a B"), (5002, None), (5003, " ")]


def test_groups_passages_and_small_blocks(spark, monkeypatch):
    rows = near_copies()
    monkeypatch.setattr(neardup, "BLOCK", 8)
    docs = extra(spark.createDataFrame(rows, "doc_id long, text string"))
    assert tuples(neardup.components_of(docs), "doc_id", "n_shingles", "component_id", "kept") == brute(rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, _, k in brute(rows) if k)


def test_index_guarantee():
    """Any two signatures within the guaranteed distance share a key."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        x = rng.integers(0, 1 << 16, neardup.SLOTS).astype("<u2")
        y = x.copy()
        y[rng.choice(neardup.SLOTS, neardup.GUARANTEED, replace=False)] ^= 1
        a, b = (s.reshape(neardup.CHUNKS, neardup.CHUNK) for s in (x, y))
        assert any((p != q).sum() <= 1 for p, q in zip(a, b, strict=True))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = neardup.components_of(extra(docs))
    assert out.count() == docs.count() and out.where("doc_id IS NULL AND NOT kept").count() == 0
    assert neardup.components_of(docs.limit(0)).count() == 0
    assert neardup.keep_one(docs).where("doc_id = 4").count() == 1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(connected_components(df, Scratch(spark, "test")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_against_sql(spark, duck):
    df = op6_minhash_neardup(spark, SMALL)
    found = duck.execute(oracle_sql()["op6_minhash_neardup"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in found.description], found.fetchall())
