"""Growable filters as tables, against filters kept in plain sets and lists."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from sketchloom.hashing import key_of
from sketchloom.operators import ordered

D = "/root/testdata/sf0.01"


def halves(text):
    h = hashlib.md5(text.encode()).hexdigest()
    return int(h[:12], 16), int(h[12:24], 16)


class PlainCuckoo:
    """Layers of sets of (fingerprint, smaller bucket): membership, whatever the placement."""

    def __init__(self, seed=""):
        self.seed, self.sets = seed, {}

    def pair(self, key, buckets, bits):
        a, b = halves(self.seed + key)
        fp = a % 2**bits or 1
        one = b % buckets
        return fp, min(one, one ^ halves(self.seed + str(fp))[0] % buckets)

    def holds(self, shard, key, heads):
        return any(self.pair(key, n // 4, w) in self.sets.get((shard, layer), ()) for layer, n, w in heads.get(shard, ()))


@pytest.mark.parametrize("seed", ["", "s"])
def test_cuckoo_table_against_plain_sets(spark, seed):
    """Every layer's content, asking and removing; how the layers came about is replayed key by key with the driver's own filter."""
    keys = [r[0] for r in spark.read.parquet(f"{D}/orders.parquet").where("o_orderkey % 3 = 0").select("o_orderkey").collect()]
    df = spark.createDataFrame([(k,) for k in keys], "o_orderkey long")
    make = lambda: ordered.ScalableCuckoo(8, 0.01, seed=seed)
    grown = ordered.grow(df, "o_orderkey", "o_orderkey", make, shards=40)
    rows, like = grown.collect(), make()
    heads, plain = {}, PlainCuckoo(seed)
    for r in rows:
        if r.a is None:
            heads.setdefault(r.shard, []).append((r.layer, r.slots, r.width))
        else:
            plain.sets.setdefault((r.shard, r.layer), set()).add((r.a, r.b))
    # each key is held by some layer of its shard, as the plain pair says
    shard = lambda k: halves("shard:" + k)[1] % 40
    assert all(plain.holds(shard(str(k)), str(k), heads) for k in keys)
    assert sum(len(s) for s in plain.sets.values()) <= len(keys)
    for layers in heads.values():  # slots and widths follow from growth and tightening
        for i, (layer, slots, width) in enumerate(sorted(layers)):
            items = 8 if i == 0 else sorted(layers)[i - 1][1] * 2
            fpp = 0.01 * 0.5**i
            assert layer == i and slots == 4 * 2 ** math.ceil(math.log2(math.ceil(items / 4))) and width == math.ceil(math.log2(2 / (1 - (1 - fpp) ** (1 / 8))))
    replay: dict = {}
    for k in sorted(keys):
        replay.setdefault(shard(str(k)), make()).insert(str(k))
    assert {(s, *row) for s, held in replay.items() for row in held.rows()} == {tuple(r) for r in rows}
    # asking
    asked = spark.range(0, 20_000, 7).selectExpr("if(id = 0, null, id) AS o_orderkey", "'x' AS _key", "1 AS _hit", "2 AS shard")
    got = {r.o_orderkey: r.found for r in ordered.with_contains(asked, key_of("o_orderkey"), grown, like, 40).collect()}
    assert got[None] is None and all(v == plain.holds(shard(str(k)), str(k), heads) for k, v in got.items() if k is not None)
    # removing reaches every layer
    gone = [k for k in keys if k % 2]
    left = ordered.remove(grown, spark.createDataFrame([(k,) for k in gone], "o_orderkey long"), key_of("o_orderkey"), like, 40)
    for s, layer in list(plain.sets):
        n, w = next((n, w) for i, n, w in heads[s] if i == layer)
        plain.sets[s, layer] -= {plain.pair(str(k), n // 4, w) for k in gone if shard(str(k)) == s}
    assert {(r.shard, r.layer, r.a, r.b) for r in left.where("a IS NOT NULL").collect()} == {(*at, *x) for at, held in plain.sets.items() for x in held}
    assert left.where("a IS NULL").count() == sum(map(len, heads.values()))
    whole = ordered.summary(left, like).agg(F.sum("held"), F.sum("overflow"), F.min("filter_count")).first()
    assert whole[0] + whole[1] == sum(map(len, plain.sets.values())) and whole[2] >= 1


def test_bloom_table_and_seed(spark):
    df = spark.range(2_000).selectExpr("id AS item", "id AS _shard", "'q' AS layer")
    one, other = ordered.ScalableBloom(100, 0.01), ordered.ScalableBloom(100, 0.01, seed="t")
    grown = {like.seed: ordered.grow(df, "item", "item", lambda like=like: ordered.ScalableBloom(100, 0.01, seed=like.seed), shards=9) for like in (one, other)}
    for like in (one, other):
        found = ordered.with_contains(spark.range(-1, 22_000).withColumnRenamed("id", "item"), key_of("item"), grown[like.seed], like, 9)
        assert found.where("found AND item BETWEEN 0 AND 1999").count() == 2_000
        assert found.where("found AND item >= 2000").count() <= 2 * 0.02 * 20_000
        s = ordered.summary(grown[like.seed], like).collect()
        assert len(s) == 9 and all(r.filter_count > 2 and not r.is_empty and r.held + r.unset == r.slots and 0 < r.estimated_fpp < 0.025 for r in s)  # a layer may pass half by a key
    assert sorted(grown[""].where("a IS NOT NULL").collect()) != sorted(grown["t"].where("a IS NOT NULL").collect())
    none = ordered.grow(df.limit(0), "item", "item", lambda: ordered.ScalableBloom(100, 0.01), shards=9)
    assert none.count() == 0 and ordered.with_contains(df, key_of("item"), none, one, 9).where("found").count() == 0


def test_accessors():
    b = ordered.ScalableBloom(100, 0.01)
    assert len(b) == 100 and not b.is_empty and b.filter_count == 1 and (b.count_ones, b.count_zeros) == (0, 100)
    for i in range(200):
        b.insert(str(i))
    assert b.count_ones + b.count_zeros == len(b) and b.filter_count > 3 and b.estimated_fpp <= 0.01 / (1 - 0.5)
    b.clear()
    assert len(b) == 100 and b.count_ones == 0
    c = ordered.ScalableCuckoo(100, 0.01, entries=8)
    assert c.is_empty and c.filter_count == 1 and c.entries_per_index == 8 and c.layers[0].spec.fingerprint_bits == 12
    for i in range(200):
        c.insert(str(i))
    assert not c.is_empty and c.estimated_fpp <= 0.01 / (1 - 0.5) and [x.spec.fingerprint_bits for x in c.layers][:2] == [12, 13]
    c.clear()
    assert c.is_empty and c.filter_count == 1
    small = ordered.CuckooLayer(ordered.CuckooSpec(1, 8, 1))
    assert small.is_empty and not small.is_nearly_full
    small.insert("foo"), small.insert("foobar")
    assert small.is_nearly_full
    small.clear()
    assert small.is_empty and not small.is_nearly_full
    f = ordered.StreamFilter(10, 0.01)
    f.insert("foo")
    assert len(f) == 70 and not f.is_empty and f.zeros == 63
    with pytest.raises(ValueError):
        ordered.CuckooSpec(1, 8, 0)
