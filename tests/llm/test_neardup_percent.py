"""The pipeline's stage links from 0.80 on, the thin query from 0.85 on."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from sketchloom.llm import neardup

from .helpers import SMALL
from .test_neardup import shingle_set


def kept_by_brute(rows, percent):
    """Smallest ids of the components over all pairs."""
    sets, root = {d: shingle_set(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            m = len(sets[a] & sets[b])
            if a < b and m and 100 * m >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in sets if find(d) == d}


def between(n=30, seed=5):
    """Pairs of 100 words with two spread words replaced (86 of 106 shingles shared, 0.81), and texts that share a passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows, passage = [], [word() for _ in range(60)]
    for i in range(n):
        t = [word() for _ in range(100)]
        rows.append((2 * i, " ".join(t)))
        t[20 + i], t[60 + i] = word(), word()
        rows.append((2 * i + 1, " ".join(t)))
        other = passage + [word() for _ in range(r.randint(8, 24))]
        rows.append((1000 + i, " ".join(other)))
    return rows


@pytest.mark.parametrize("block", [8, 1024])
def test_stage_links_between_80_and_85(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = between()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()}
    assert got == kept_by_brute(rows, 80) and not any(2 * i + 1 in got for i in range(30))
    assert {r.doc_id for r in neardup.keep_one(docs, percent=85).collect()} == kept_by_brute(rows, 85) > got


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    wordless = {d for d, t in rows if not shingle_set(t)}
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()}
    assert got == kept_by_brute(rows, 80) | wordless


def test_sizes_follow_from_the_percent():
    a, b = neardup.Rule(80), neardup.Rule(85)
    assert (b.chunks, b.distance) == (12, 31) and a.chunks > b.chunks and a.distance > b.distance
    with pytest.raises(ValueError):
        neardup.Rule(100)


def test_pipeline_keeps_one_from_80_on(spark):
    """Of what the rules kept, the smallest id of each component at 0.80 reaches the packed corpus, and nothing else."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    two = corpus_pipeline.apply_rules(spark, corpus_pipeline.classify_quality(spark, docs, SMALL), SMALL)
    rows = [(r.doc_id, r.text) for r in two.collect()]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().collect()} == kept_by_brute(rows, 80) < kept_by_brute(rows, 85)
