from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from sketchloom.llm import shards
from sketchloom.llm.queries import op9_sharding

from .helpers import SMALL, extra, odd_documents


def slow_walk(counts, n, slack=0.0):
    """One document at a time, clockwise."""
    points = shards.ring_points(n)
    room = shards.capacities(sum(counts.values()), n, slack)
    out = []
    for slot in sorted(counts):
        for _ in range(counts[slot]):
            i = next((i for i, (p, _) in enumerate(points) if p >= slot), 0)
            while not room[points[i % len(points)][1]]:
                i += 1
            s = points[i % len(points)][1]
            room[s] -= 1
            out.append((slot, s))
    return out


def test_walk_against_one_at_a_time():
    counts = {i * 37 % (1 << shards.RING_BITS): i % 9 + 1 for i in range(300)} | {5: 900}
    for n, slack in ((16, 0.0), (5, 0.1), (1, 0.0)):
        pieces = shards.walk(counts, n, slack)
        assert [(slot, s) for slot, a, b, s, _ in pieces for _ in range(b - a)] == slow_walk(counts, n, slack)


def test_query_balances_rows(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op9_sharding(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    n = Counter(r.shard for r in rows)
    assert set(n) == set(range(16)) and max(n.values()) - min(n.values()) <= 1
    slots = defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_few_documents_move(spark):
    """With slack, a further shard takes far fewer rows than dealing by remainder would move."""
    docs = spark.range(4_000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    before, after = ({r.doc_id: r.shard for r in shards.assign_shards(docs, n, slack=0.25).collect()} for n in (16, 17))
    moved = sum(before[d] != after[d] for d in before)
    assert moved < 0.25 * len(before)


def test_movement_of_the_query_without_slack(spark):
    """The query's own law: counts stay one apart, and a 17th shard moves at most twice the ideal share."""
    docs = spark.range(50_000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    before, after = ({r.doc_id: r.shard for r in shards.assign_shards(docs, n).collect()} for n in (16, 17))
    moved = sum(before[d] != after[d] for d in before)
    assert 1 / 17 - 0.001 <= moved / len(before) <= 2 / 17


def test_shards_against_one_at_a_time(spark):
    """Documents' shards and slots by walking the ring for each document alone, in the order of places; copies count one by one."""
    docs = odd_documents(spark).union(spark.range(3_000).selectExpr("id % 900", "if(id % 7 = 0, null, cast(id % 900 as string))", "''", "id", "''"))
    n = 7
    rows = docs.selectExpr("doc_id", "coalesce(octet_length(text), 0) + 1L AS size", "coalesce(crc32(cast(text AS binary)), 0L) AS crc").selectExpr("*", "xxhash64(doc_id, size, crc) AS h").collect()
    ordered = sorted(((r.h % 2**64 >> (64 - shards.RING_BITS), r.h, r.doc_id is not None, r.doc_id or 0, r.crc, r["size"]) for r in rows))
    points, room, taken, expected = shards.ring_points(n), shards.capacities(len(rows), n, 0.0), [0] * n, []
    for ring, _, known, doc, crc, size in ordered:
        i = next((i for i, (p, _) in enumerate(points) if p >= ring), 0)
        while not room[points[i % len(points)][1]]:
            i += 1
        s = points[i % len(points)][1]
        room[s] -= 1
        expected.append((doc if known else None, size, crc, s, taken[s]))
        taken[s] += 1
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in shards.assign_shards(docs, n).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_a_third_are_copies_of_one(spark, monkeypatch):
    monkeypatch.setattr(shards, "COPIES", 16)
    docs = spark.range(3_000).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "if(id % 3 = 0, 'same', cast(id AS string)) AS text")
    rows = shards.assign_shards(docs, 5).collect()
    assert len(rows) == 3_000 and sum(r.doc_id is None for r in rows) == 1_000
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(600))


def test_written_shards_have_bounded_files(spark, tmp_path):
    out = shards.assign_shards(spark.range(1_000).selectExpr("id AS doc_id", "'x' AS text"), 4)
    shards.write_shards(out, str(tmp_path / "s"), file_rows=100)
    for s in range(4):
        parts = [spark.read.parquet(str(f)) for f in sorted((tmp_path / "s" / f"shard={s}").glob("*.parquet"))]
        slots = [[r.slot for r in p.collect()] for p in parts]
        assert sorted(x for p in slots for x in p) == list(range(250)) and all(p == sorted(p) for p in slots) and len(parts) > 1


def test_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    out = shards.assign_shards(extra(docs), 3)
    n = Counter(r.shard for r in out.collect())
    assert sum(n.values()) == docs.count() and max(n.values()) - min(n.values()) <= 1
    assert shards.assign_shards(docs.limit(0)).count() == 0
    shards.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()
