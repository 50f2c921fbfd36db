"""Growable filters in large shards: the work for a key does not grow with the shard, and keys meet filters without a row for each layer."""

from __future__ import annotations

import random
import time

import pytest

from sketchloom.hashing import key_of, text_pairs
from sketchloom.operators import ordered

MAKE = {"bloom": lambda seed="": ordered.ScalableBloom(100, 0.01, seed=seed), "cuckoo": lambda seed="": ordered.ScalableCuckoo(8, 0.01, seed=seed)}


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", MAKE)
def test_asking_makes_no_row_for_a_layer(spark, kind):
    df = spark.range(3_000).withColumnRenamed("id", "item")
    grown = ordered.grow(df, "item", "item", MAKE[kind], shards=2)
    asked = spark.range(0, 9_000, 3).withColumnRenamed("id", "item")
    found = ordered.with_contains(asked, key_of("item"), grown, MAKE[kind](), 2)
    plan = plan_of(found)
    assert plan.count("Join") == 1 and "Generate" not in plan  # the verdict's join with the rows
    held = {r.item for r in found.where("found").collect()}
    assert held >= set(range(0, 3_000, 3)) and len(held) < 1_000 + 100


def test_removing_makes_no_row_for_a_layer(spark):
    df = spark.range(3_000).withColumnRenamed("id", "item")
    grown = ordered.grow(df, "item", "item", MAKE["cuckoo"], shards=3)
    like, gone = MAKE["cuckoo"](), df.where("item % 5 = 0")
    left = ordered.remove(grown, gone, key_of("item"), like, 3)
    assert "Join" not in plan_of(left)
    plain: dict[int, ordered.ScalableCuckoo] = {}
    for k in map(str, range(3_000)):
        plain.setdefault(int(ordered.digest_pair(k, "shard:")[1] % 3), MAKE["cuckoo"]()).insert(k)
    for k in map(str, range(0, 3_000, 5)):
        plain[ordered.digest_pair(k, "shard:")[1] % 3].remove(k)
    assert {tuple(r) for r in left.collect()} == {(s, *row) for s, held in plain.items() for row in held.rows()}
    assert ordered.remove(grown, gone.limit(0), key_of("item"), like, 3).count() == grown.count()


@pytest.mark.parametrize("seed", ["", "s"])
@pytest.mark.parametrize("kind", MAKE)
def test_batches_grow_what_single_keys_grow(kind, seed):
    r = random.Random(5)
    keys = [str(r.randrange(2_500)) for _ in range(4_000)]
    one, many, i = MAKE[kind](seed), MAKE[kind](seed), 0
    for k in keys:
        one.insert(k)
    while i < len(keys):
        n = r.choice((1, 7, 300, 1_500))
        many.insert_all(keys[i : i + n])
        i += n
    assert list(one.rows()) == list(many.rows()) and len(one) == len(many) and one.filter_count == many.filter_count > 5


class Unwalked(list):
    def __iter__(self):
        raise AssertionError("all buckets were walked through for one key")


def test_no_key_counts_all_slots():
    held = MAKE["cuckoo"]()
    held.layers[-1].table = Unwalked(held.layers[-1].table)
    for k in range(5):
        assert held.insert(str(k)) and len(held.layers[0]) == k + 1


@pytest.mark.parametrize("kind", MAKE)
def test_a_key_costs_the_same_in_a_large_shard(kind):
    held, took = MAKE[kind](), {}
    for n in (4_000, 40_000):
        held.clear()
        began = time.process_time()
        for s in range(0, n, 2_000):
            held.insert_all([str(k) for k in range(s, s + 2_000)])
        took[n] = time.process_time() - began
    assert took[40_000] < 25 * took[4_000] + 1


@pytest.mark.parametrize("n", [0, 1, 999, 1_001, 3_000])
@pytest.mark.parametrize("seed", ["", "s"])
def test_hash_pairs_of_many_texts(n, seed):
    r = random.Random(n)
    texts = ["".join(r.choice("aé漢 9") for _ in range(r.randrange(70))) for _ in range(n)]
    a, b = text_pairs(texts, seed)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [ordered.digest_pair(t, seed) for t in texts]
