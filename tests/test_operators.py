"""Semantics beyond the oracles: merging, removal, nulls, accuracy, order, streaming, saving."""

from __future__ import annotations

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sketchloom.hashing import key_of, sip_positions
from sketchloom.operators import bloom, cms, hll, ordered, similarity
from sketchloom.operators import fingerprint as fp
from sketchloom.operators.bloom import BloomSpec
from sketchloom.sources import load_sketch, save_sketch, table
from sketchloom.streaming import deduplicate_stream, windowed_cells, windowed_registers

from .conftest import SMALL


def items(spark, values, kind="long"):
    return spark.createDataFrame([(v,) for v in values], f"item {kind}")


def test_bloom_has_no_false_negatives_and_keeps_its_rate(spark):
    spec = BloomSpec.for_items(1_000, 0.01)
    words = bloom.build(spark.range(1_000).withColumnRenamed("id", "item"), key_of("item"), spec)
    asked = spark.range(21_000).withColumnRenamed("id", "item")
    found = bloom.with_contains(asked, key_of("item"), words, spec).where("found")
    assert found.where("item < 1000").count() == 1_000
    assert found.where("item >= 1000").count() <= 2 * 0.01 * 20_000
    ones = bloom.stats(words, spec).first()
    assert ones.ones + ones.zeros == spec.bits and ones.has_items


def test_bloom_merges_as_one(spark):
    spec = BloomSpec.for_items(300, 0.01)
    parts = [bloom.build(items(spark, range(a, a + 100)), key_of("item"), spec) for a in (0, 100, 200)]
    whole = bloom.build(items(spark, [*range(300), *range(300), None]), key_of("item"), spec)
    assert sorted(bloom.union(*parts).collect()) == sorted(whole.collect())
    assert sorted(bloom.intersect(whole, parts[0]).collect()) == sorted(parts[0].collect())
    assert bloom.stats(bloom.clear(whole), spec).first().ones == 0


def test_quick_hashes(spark):
    """The other provider, on keys as they are: no false negative, its rate kept, nulls stay null; and the exact join that uses it."""
    spec = replace(BloomSpec.for_items(1_000, 0.01), provider="xx")
    words = bloom.build(spark.range(1_000).withColumnRenamed("id", "item"), F.col("item"), spec)
    asked = spark.range(21_000).selectExpr("if(id = 20999, null, id) AS item")
    for limit in (0, 1 << 20):
        found = bloom.with_contains(asked, F.col("item"), words, spec, limit=limit)
        assert found.where("found AND item < 1000").count() == 1_000 and found.where("found AND item >= 1000").count() <= 2 * 0.01 * 20_000
        assert [r.found for r in found.where("item IS NULL").collect()] == [None]
    big = asked.selectExpr("item AS k", "'x' AS v")
    for small in (spark.range(900, 1_100).selectExpr("id AS k2"), spark.range(900, 1_100).selectExpr("cast(id AS string) AS k2")):
        out = bloom.reduced_join(big, small, "k", "k2", BloomSpec.for_items(200, 0.01))
        assert sorted(r.k for r in out.collect()) == list(range(900, 1_100))
    with pytest.raises(ValueError):
        bloom.positions(F.lit("x"), replace(spec, provider="md4"))


def test_null_and_empty_probes(spark):
    spec = BloomSpec.for_items(10, 0.01)
    empty = bloom.build(items(spark, []), key_of("item"), spec)
    for limit in (0, 1 << 20):
        got = {r.item: r.found for r in bloom.with_contains(items(spark, [1, None]), key_of("item"), empty, spec, limit=limit).collect()}
        assert got == {1: False, None: None}
    cuckoo = fp.CuckooSpec.for_items(10)
    got = {r.item: r.found for r in fp.with_contains(items(spark, [1, None]), key_of("item"), fp.build(items(spark, [1, None]), key_of("item"), cuckoo), cuckoo).collect()}
    assert got == {1: True, None: None}


@pytest.mark.parametrize("spec", [fp.CuckooSpec.for_fpp(1_000, 0.01), fp.QuotientSpec.for_fpp(1_000, 0.01)])
def test_fingerprint_sets(spark, spec):
    one = fp.build(items(spark, range(1_000)), key_of("item"), spec)
    both = fp.insert(one, items(spark, range(500, 1_500)), key_of("item"), spec)
    assert sorted(both.collect()) == sorted(fp.build(items(spark, range(1_500)), key_of("item"), spec).collect())
    left = fp.remove(both, items(spark, range(1_000)), key_of("item"), spec)
    asked = spark.range(20_000).withColumnRenamed("id", "item")
    assert fp.contained(asked.where("item < 1000"), key_of("item"), left, spec).count() <= 30
    assert fp.contained(asked.where("item >= 1000 AND item < 1500"), key_of("item"), left, spec).count() >= 480
    assert fp.contained(asked.where("item >= 2000"), key_of("item"), one, spec).count() <= 2 * 0.01 * 18_000


@pytest.mark.parametrize("spec", [fp.QuotientSpec(3, 4), fp.CuckooSpec(8, 8)])
def test_removal_touches_only_its_pair(spark, spec):
    """In a filter so small that runs shift: removing what is absent changes nothing, removing a member takes its pair alone."""
    words = [f"w{i}" for i in range(7)]
    key = F.col("item")
    stored = fp.build(items(spark, words, "string"), key, spec)
    pairs = {w: tuple(fp.build(items(spark, [w], "string"), key, spec).first()) for w in [*words, "x1", "x2", "x3"]}
    held = set(pairs[w] for w in words)
    for gone in ([], ["x1", "x2", "x3"], ["w0"], ["w1", "w3", "x1"], words):
        left = {tuple(r) for r in fp.remove(stored, items(spark, gone, "string"), key, spec).collect()}
        assert left == held - {pairs[w] for w in gone}
    assert fp.is_empty(fp.clear(stored)) and not fp.is_empty(stored)


def test_quotient_layout_wraps(spark):
    spec = fp.QuotientSpec(3, 4)
    stored = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (0, 5), (2, 2)], "quotient long, remainder long")
    got = {r.slot: (r.quotient, r.remainder, r.is_occupied, r.is_continuation, r.is_shifted) for r in fp.quotient_layout(stored, spec).collect()}
    assert got == {
        7: (7, 1, True, False, False), 0: (7, 2, True, True, True), 1: (7, 3, False, True, True), 2: (0, 5, True, False, True), 3: (2, 2, False, False, True),
    }


def test_cms_weights_removal_and_bounds(spark):
    spec = cms.CmsSpec.for_error(0.01, 0.02)
    rows = spark.createDataFrame([("foo", 3), ("bar", 5), ("foo", -2), (None, 9)], "item string, w long")
    sketch = cms.build(rows, F.col("item"), spec, F.col("w"))
    got = {r.item: (r["min"], r["mean"], r.median_bias) for r in cms.estimate(items(spark, ["foo", "bar", "baz", None], "string"), F.col("item"), sketch, spec).collect()}
    assert got["foo"][0] == 1 and got["bar"][0] == 5 and got["baz"][0] == 0 and got[None] == (None, None, None)
    none = cms.removed(sketch, rows, F.col("item"), spec, F.col("w"))
    assert none.where("cnt <> 0").count() == 0
    lines = table(spark, SMALL, "lineitem")
    exact = lines.groupBy(F.col("l_partkey").alias("item")).count()
    est = cms.estimate(exact, key_of("item"), cms.build(lines, key_of("l_partkey"), spec), spec, {"e": cms.count_min})
    r = est.agg(F.min(F.col("e") - F.col("count")), F.avg((F.col("e") - F.col("count") <= 0.01 * lines.count()).cast("double"))).first()
    assert r[0] >= 0 and r[1] >= 0.98


def test_hll_accuracy_merge_and_emptiness(spark):
    p = 12
    ids = spark.range(50_000).withColumnRenamed("id", "item")
    sketch = hll.build(ids, key_of("item"), p)
    got = hll.estimate(sketch, p).first().estimate
    assert abs(got - 50_000) / 50_000 < 4 * 1.04 / math.sqrt(1 << p)
    halves = [hll.build(ids.where(c), key_of("item"), p) for c in ("item < 30000", "item >= 20000")]
    assert sorted(hll.merge(*halves).collect()) == sorted(sketch.collect())
    assert hll.estimate(hll.build(items(spark, []), key_of("item"), p), p).first().estimate == 0
    assert [round(hll.estimate(hll.build(items(spark, v), key_of("item"), 14), 14).first().estimate) for v in ([0, 1, 2, 0, 1, 2], [0, 1, 2, 3, None])] == [3, 4]
    # more items than registers: no zero register is left, and the estimate stays finite
    assert 15_000 < hll.estimate(hll.build(ids.where("item < 20000"), key_of("item"), 6), 6).first().estimate < 30_000
    assert hll.count_distinct(ids, key_of("item")).count() == 1 and hll.fast_count(ids, F.col("item")).count() == 1


def test_similarity_of_sentences(spark):
    texts = ["the cat sat on a mat", "the cat sat on the mat", "we all scream for ice cream", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = docs.select("doc_id", similarity.shingles(similarity.tokens(F.col("text")), 2).alias("s"))
    pairs = sets.alias("x").join(sets.alias("y"), F.expr("x.doc_id < y.doc_id")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), similarity.jaccard(F.col("x.s"), F.col("y.s")).alias("j"))
    got = {(r.a, r.b): r.j for r in pairs.collect()}
    assert got[0, 1] == pytest.approx(3 / 7) and got[0, 2] == 0
    both = docs.alias("x").join(docs.alias("y"), F.expr("x.doc_id < y.doc_id")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), similarity.jaccard_of_texts("x.text", "y.text", F.lit(2)).alias("j"))
    assert {(r.a, r.b): r.j for r in both.collect()} == pytest.approx({k: v for k, v in got.items()})
    assert docs.select(similarity.jaccard_of_texts(F.lit("a"), F.lit(None).cast("string"), F.lit(2))).first()[0] is None
    assert sets.select(similarity.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0] is None
    hashed = similarity.sim_hashes(docs, "doc_id", "text", 2)
    assert {r.doc_id for r in hashed.collect()} == {0, 1, 2}
    found = {(r.doc_a, r.doc_b) for r in similarity.similar_candidates(hashed, "doc_id", 2).collect()}
    assert (0, 1) in found
    sip = docs.select("doc_id", similarity.sip_min_hashes(F.col("text"), F.lit(2), F.lit(100)).alias("m"))
    m = {r.doc_id: r.m for r in sip.collect()}
    assert sum(a == b for a, b in zip(m[0], m[1], strict=True)) == 49 and m[3] is None


def test_sip_positions(spark):
    got = items(spark, ["foo"], "string").select(sip_positions(F.col("item"), F.lit(7), F.lit(96)).alias("p")).first().p
    assert len(set(got)) == 7


def test_scalable_filters():
    b = ordered.ScalableBloom(100, 0.01)
    for i in range(15):
        b.insert(str(i))
    assert [x.bits for x in b.layers] == [100, 200] and [x.hashes for x in b.layers] == [7, 8]
    assert all(b.contains(str(i)) for i in range(15))
    c = ordered.ScalableCuckoo(100, 0.01)
    n = i = 0
    while n < 130:
        n += c.insert(str(i))
        i += 1
    assert [x.spec.fingerprint_bits for x in c.layers] == [11, 12] and c.capacity == 384 and len(c) == 130
    for j in range(i):
        c.remove(str(j))
    assert len(c) == 0
    small = ordered.CuckooLayer(fp.CuckooSpec(1, 8, 1))
    small.insert("foo"), small.insert("foobar")
    assert len(small) == 1 and len(small.extra) == 1 and small.contains("foo") and small.contains("foobar")


@pytest.mark.parametrize("rule", ["bs", "bssd", "rlbs"])
def test_stream_filter(rule):
    f = ordered.StreamFilter(10, 0.01, rule)
    assert f.insert("foo") and f.ones == 7 and len(f) == 70 and not f.insert("foo") and f.contains("foo")
    again = ordered.StreamFilter(10, 0.01, rule).load(f.dump())
    assert again.contains("foo") and again.step == f.step and (again.data, again.held) == (f.data, f.held)
    f.clear()
    assert f.ones == 0
    wide = ordered.StreamFilter(1 << 14, 0.01, rule)
    assert sum(wide.insert(str(i % 500)) for i in range(2_000)) < 700


@pytest.mark.parametrize("rule", ["bs", "rlbs"])
def test_stream_equals_batch(spark, tmp_path, rule):
    events = table(spark, SMALL, "events").select("event_id", "user_id")
    batch = ordered.deduplicate(events, "user_id", "event_id", 256, 0.01, rule, shards=3)
    folder = str(tmp_path / "in")
    for a in range(0, 1000, 400):  # three files, in order
        events.where((F.col("event_id") >= a) & (F.col("event_id") < a + 400)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = deduplicate_stream(stream, "user_id", "event_id", 256, 0.01, rule, shards=3)
    q = out.writeStream.format("memory").queryName(f"dedup_{rule}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    columns = ["event_id", "item", "shard", "is_distinct"]
    assert sorted(spark.table(f"dedup_{rule}").select(columns).collect()) == sorted(batch.select(columns).collect())


def test_windowed_sketches(spark):
    events = table(spark, SMALL, "events")
    days = windowed_registers(events, "ts", key_of("user_id"), 8, "1 day", late="1 hour")
    assert days.select("window_start").distinct().count() == events.select(F.to_date("ts")).distinct().count()
    cells = windowed_cells(events, "ts", key_of("user_id"), cms.CmsSpec(2, 50), "1 day")
    assert cells.where("row = 0").agg(F.sum("cnt")).first()[0] == events.count()


def test_saved_sketch(spark, tmp_path):
    spec = BloomSpec.for_items(10, 0.01)
    words = bloom.build(items(spark, range(10)), key_of("item"), spec)
    save_sketch(words, spec, str(tmp_path / "b"))
    back, same = load_sketch(spark, str(tmp_path / "b"))
    assert same == spec and sorted(back.collect()) == sorted(words.collect())


def test_estimated_rates_after_one_item(spark):
    """A plain filter for 100 items at 0.01 has 959 bits, 7 of them set; a cuckoo filter one slot of 128."""
    spec = BloomSpec.for_items(100, 0.01)
    r = bloom.stats(bloom.build(items(spark, ["foo"], "string"), F.col("item"), spec), spec).first()
    assert (spec.bits, spec.hashes, r.ones) == (959, 7, 7) and r.estimated_fpp == pytest.approx((7 / 959) ** 7)
    cuckoo = fp.CuckooSpec.for_items(100)
    r = fp.cuckoo_stats(fp.build(items(spark, ["foo"], "string"), F.col("item"), cuckoo), cuckoo).first()
    assert (cuckoo.buckets, cuckoo.capacity) == (32, 128) and r.estimated_fpp == pytest.approx(1 - (254 / 255) ** (8 / 128))
    assert not r.is_empty and not r.is_nearly_full
    full = fp.cuckoo_stats(fp.build(items(spark, range(5)), key_of("item"), fp.CuckooSpec(1, 16, 4)), fp.CuckooSpec(1, 16, 4)).first()
    assert full.is_nearly_full and full.overflow == 1
    none = fp.quotient_stats(fp.build(items(spark, []), key_of("item"), fp.QuotientSpec(8, 4)), fp.QuotientSpec(8, 4)).first()
    assert none.is_empty and none.estimated_fpp == 0


# The 64-bit fingerprints of the three sentences' windows of two words.
GOLDEN = [
    0b1000_0101_1011_1000_0010_1111_1011_0000_1110_1000_0011_1011_0110_0100_0000_0100,
    0b0000_0101_0011_1000_0001_1111_1111_1000_0111_1011_0011_0001_1010_0001_0000_0110,
    0b1001_0011_1010_1010_1100_1011_0000_0000_0010_1100_0010_0001_0101_1000_0111_1101,
]
SENTENCES = ["the cat sat on a mat", "the cat sat on the mat", "we all scream for ice cream"]


def test_values_fixed_by_siphash(spark):
    """64-bit fingerprints of three sentences, their distances and their one candidate pair; the similarity of 100 minima."""
    docs = spark.createDataFrame(list(enumerate(SENTENCES)), "doc_id long, text string")
    hashed = similarity.sim_hashes(docs, "doc_id", "text", 2, provider="sip24")
    got = {r.doc_id: r.sim_hash % 2**64 for r in hashed.collect()}
    assert got == {i: similarity.sip_fingerprint(similarity.windows_of(t, 2)) for i, t in enumerate(SENTENCES)}
    assert [got[i] for i in range(3)] == GOLDEN
    x, y = (hashed.select(F.col("doc_id").alias(f"d{n}"), F.col("sim_hash").alias(f"h{n}")) for n in (1, 2))
    far = {(r.d1, r.d2): r.n for r in x.join(y, F.col("d1") < F.col("d2")).select("d1", "d2", similarity.hamming(F.col("h1"), F.col("h2")).alias("n")).collect()}
    assert far == {(i, j): bin(got[i] ^ got[j]).count("1") for i in range(3) for j in range(i + 1, 3)} and far[0, 1] == min(far.values())
    assert {(0, 1), (1, 2)} <= {tuple(r) for r in similarity.similar_candidates(hashed, "doc_id", 2, bits=64).collect()}
    # with a window of two, every rotation's neighbours in unsigned order
    expected = set()
    for rot in range(64):
        order = sorted(range(3), key=lambda i: ((got[i] << rot | got[i] >> (64 - rot)) % 2**64, i))
        expected |= {tuple(sorted(p)) for p in zip(order, order[1:])}
    assert {tuple(r) for r in similarity.similar_candidates(hashed, "doc_id", 2, bits=64).collect()} == expected
    m = {r.doc_id: r.signature for r in similarity.min_hashes(docs, "doc_id", "text", 2, 100, provider="sip24").collect()}
    assert sum(a == b for a, b in zip(m[0], m[1], strict=True)) == 49
    assert [v % 2**64 for v in m[0]] == similarity.sip_signature(similarity.windows_of(SENTENCES[0], 2), 100)


def test_seeds_and_keys_matter(spark):
    docs = spark.createDataFrame(list(enumerate(SENTENCES)), "doc_id long, text string")
    made = [{"seed": "a"}, {"seed": "b"}, {"provider": "sip24"}, {"provider": "sip24", "keys": ((3, 4), (5, 6))}]
    for f in (lambda **k: similarity.min_hashes(docs, "doc_id", "text", 2, 8, **k), lambda **k: similarity.sim_hashes(docs, "doc_id", "text", 2, **k)):
        first = [str(f(**k).orderBy("doc_id").first()[1]) for k in made]
        assert len(set(first)) == 4


def test_minima_of_any_number_of_hashes(spark):
    """More hashes than an aggregate would hold, against plain arithmetic; odd texts; names that clash."""
    texts = [*SENTENCES, "one", "", None, "a  b", "x y " * 3_000]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, signature string")
    got = {r.doc_id: r.signature for r in similarity.min_hashes(docs, "doc_id", "text", 2, 300, "s").collect()}
    for i, t in enumerate(texts):
        words = [] if t is None else t.split(" ")
        pairs = [ordered.digest_pair(" ".join(words[j : j + 2]), "s") for j in range(len(words) - 1)]
        expected = [min(a + n * b + n * (n - 1) * (n - 2) // 6 for a, b in pairs) for n in range(300)] if pairs else None
        assert got.get(i) == expected
    s = docs.select("doc_id", F.col("text").alias("t"))
    one = similarity.sim_hashes(s, "doc_id", "t", 2)
    assert {r.doc_id for r in one.collect()} == {0, 1, 2, 6, 7} and one.columns == ["doc_id", "sim_hash"]
    with pytest.raises(ValueError):
        similarity.min_hashes(docs, "doc_id", "text", 2, 0)
    with pytest.raises(ValueError):
        similarity.sim_hashes(docs, "doc_id", "text", 2, provider="md4")


def test_shingles_of_any_width(spark):
    texts = ["a b c d", "a", "", "a  b", "x x x x x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width in (1, 2, 3, 5):
        got = {r.doc_id: r.s for r in docs.select("doc_id", similarity.shingles(similarity.tokens(F.col("text")), width).alias("s")).collect()}
        assert got == {i: [" ".join(w) for w in similarity.windows_of(t, width)] for i, t in enumerate(texts)}
    got = {r.doc_id: (r.n, r.n_distinct) for r in similarity.shingle_counts(docs, "doc_id", "text", 2).collect()}
    assert got == {0: (3, 3), 3: (2, 2), 4: (4, 1)}


#: Names that operators use inside, and names of their results' columns.
CLASHING = "_a _b _key _asked _pos _word _at _words word word_idx fingerprint min_bucket quotient remainder _fingerprint _hit total _total _cell _cells _values row col cnt _w register rho _set _sum shard layer slots width a b _other".split()


def test_columns_of_any_name_survive(spark):
    """Every public function that takes a user's table keeps its columns and its rows, whatever they are called."""
    df = items(spark, [1, 2, 3, None])
    clash = df.withColumns({c: F.lit(f"kept {c}") for c in CLASHING})
    key = key_of("item")
    bspec, cspec, qspec, grid = BloomSpec.for_items(10, 0.01), fp.CuckooSpec.for_items(10), fp.QuotientSpec(8, 4), cms.CmsSpec(3, 50)
    like = ordered.ScalableBloom(100, 0.01)
    words = bloom.build(clash, key, bspec)
    results = [bloom.with_contains(clash, key, words, bspec, limit=n) for n in (0, 1 << 20)]
    results += [fp.with_contains(clash, key, fp.build(clash, key, s), s) for s in (cspec, qspec)]
    results += [cms.estimate(clash, key, cms.build(clash, key, grid), grid, {"found": cms.count_min}, limit=n) for n in (0, 1 << 20)]
    grown = ordered.grow(clash, "item", "item", lambda: ordered.ScalableBloom(100, 0.01), 4)
    results.append(ordered.with_contains(clash, key, grown, like, 4))
    for out in results:
        assert out.columns == [*clash.columns, "found"]
        rows = {r.item: r for r in out.collect()}
        assert set(rows) == {1, 2, 3, None} and rows[None].found is None and all(rows[i].found for i in (1, 2, 3))
        assert all(r[c] == f"kept {c}" for r in rows.values() for c in CLASHING)
    for out in (bloom.contained(clash, key, words, bspec), fp.contained(clash, key, fp.build(clash, key, cspec), cspec), fp.contained(clash, key, fp.build(clash, key, qspec), qspec)):
        assert out.columns == clash.columns and out.count() == 3
    assert bloom.build(clash.withColumn("pos", F.col("item")), key, bspec, "pos").columns == ["pos", "word_idx", "word"]
    assert cms.build(clash, key, grid, group="_key").columns == ["_key", "row", "col", "cnt"]
    assert hll.estimate(hll.build(clash, key, 10, ["_set"]), 10, ["_set"]).columns == ["_set", "estimate"]
    assert ordered.deduplicate(clash, "item", "_a", 16, 0.01).columns == ["_a", "item", "shard", "is_distinct"]
    for again in (lambda: bloom.with_contains(clash, key, words, bspec, "row"), lambda: fp.with_contains(clash, key, grown, cspec, "TOTAL"), lambda: cms.estimate(clash, key, grown, grid, {"_a": cms.count_min})):
        with pytest.raises(ValueError):
            again()


def test_large_sketches_are_joined(spark):
    """Beyond the limits nothing is collected into one value, and answers are the same."""
    spec = cms.CmsSpec.for_error(0.01, 0.02)
    rows = spark.range(5_000).selectExpr("if(id % 50 = 0, null, id % 97) AS item")
    sketch = cms.build(rows, key_of("item"), spec)
    asked = spark.range(-5, 120).selectExpr("if(id < -3, null, id) AS item")
    one, two = (cms.estimate(asked, key_of("item"), sketch, spec, limit=n) for n in (0, 1 << 20))
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)
    assert not cms.is_empty(sketch) and cms.is_empty(cms.clear(sketch))
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "grid" not in plan


def test_rollup_of_any_levels(spark):
    """Every level from one aggregate equals counting that level alone; nulls among the groups are groups."""
    p, df = 8, table(spark, SMALL, "lineitem").selectExpr("l_orderkey AS item", "nullif(l_returnflag, 'R') AS x", "l_linestatus AS y", "l_linenumber % 2 AS z")
    got = hll.rollup(hll.build(df, key_of("item"), p, ["x", "y", "z"]), p, ["x", "y", "z"]).collect()
    for level, names in ((0, ["x", "y", "z"]), (1, ["x", "y"]), (2, ["x"]), (3, [])):
        alone = hll.estimate(hll.build(df, key_of("item"), p, names), p, names).collect()
        of = lambda rows, names=names: sorted((*(str(r[n]) for n in names), r.estimate) for r in rows)
        assert of(r for r in got if r.level == level) == of(alone)
    assert hll.is_empty(hll.clear(hll.build(df, key_of("item"), p))) and not hll.is_empty(hll.build(df, key_of("item"), p))
