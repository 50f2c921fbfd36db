"""The queries: one for each operator, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params
from ..functions import popcount
from ..hashing import key_of
from ..operators import bloom, cms, hll, ordered, similarity
from ..operators import fingerprint as fp
from ..operators.bloom import BloomSpec
from ..shipping import ship
from ..sources import table

CUSTOMERS = BloomSpec.for_items(20_000, 0.01)
BUILDING = BloomSpec.for_items(4_000, 0.01)
URGENT = BloomSpec.for_items(40_000, 0.01)
USERS = BloomSpec.for_bits_and_fpp(1 << 15, 0.01)
PARTS = BloomSpec.partitioned_for_items(4_000, 0.01)
CUCKOO = fp.CuckooSpec.for_fpp(20_000, 0.01)
QUOTIENT = fp.QuotientSpec.for_fpp(20_000, 0.01)
QUOTIENT_SMALL = fp.QuotientSpec(10, 6)
GRID = cms.CmsSpec.for_error(0.005, 0.02)
P = 10
WIDTH = 3
HASHES = 32


def _key(name: str) -> Column:
    return key_of(name)


def _rounded(df: DataFrame, name: str = "estimated_fpp") -> DataFrame:
    return df.withColumn(name, F.round(name, 9))


def bloom_words(spark: SparkSession, d: str) -> DataFrame:
    return bloom.build(table(spark, d, "customer"), _key("c_custkey"), CUSTOMERS)


def bloom_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(bloom.stats(bloom_words(spark, d), CUSTOMERS))


def bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose customer may be in the segment, false positives included."""
    some = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    words = bloom.build(some, _key("c_custkey"), BUILDING)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return bloom.with_contains(orders, _key("o_custkey"), words, BUILDING)


def bloom_probe_by_join(spark: SparkSession, d: str) -> DataFrame:
    """The same through the join that filters too large to broadcast take."""
    some = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    words = bloom.build(some, _key("c_custkey"), BUILDING)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return bloom.with_contains(orders, _key("o_custkey"), words, BUILDING, limit=0)


def bloom_semijoin(spark: SparkSession, d: str) -> DataFrame:
    """Exact: the filter only thins the large side before the join."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderstatus")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    joined = bloom.reduced_join(lines, urgent, "l_orderkey", "o_orderkey", URGENT)
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n_lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


def _users(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return bloom.build(table(spark, d, "events").where(F.col("event_type") == kind), _key("user_id"), USERS)


def bloom_union(spark: SparkSession, d: str) -> DataFrame:
    return bloom.union(_users(spark, d, "click"), _users(spark, d, "purchase"))


def bloom_intersect(spark: SparkSession, d: str) -> DataFrame:
    return bloom.intersect(_users(spark, d, "click"), _users(spark, d, "purchase"))


def bloom_by_group(spark: SparkSession, d: str) -> DataFrame:
    words = bloom.build(table(spark, d, "events"), _key("user_id"), USERS, "event_type")
    return words.groupBy("event_type").agg(F.sum(popcount(F.col("word"))).alias("ones"))


def pbloom_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(bloom.stats(bloom.build(table(spark, d, "part").where("p_size <= 10"), _key("p_partkey"), PARTS), PARTS))


def pbloom_probe(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    words = bloom.build(parts.where("p_size <= 10"), _key("p_partkey"), PARTS)
    return bloom.with_contains(parts.select("p_partkey"), _key("p_partkey"), words, PARTS)


def _small_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size <= 25")


def cuckoo_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fp.build(_small_parts(spark, d), _key("p_partkey"), CUCKOO)


def cuckoo_contains(spark: SparkSession, d: str) -> DataFrame:
    return fp.with_contains(table(spark, d, "part").select("p_partkey"), _key("p_partkey"), cuckoo_fingerprints(spark, d), CUCKOO)


def cuckoo_remove(spark: SparkSession, d: str) -> DataFrame:
    return fp.remove(cuckoo_fingerprints(spark, d), table(spark, d, "part").where("p_size <= 5"), _key("p_partkey"), CUCKOO)


def cuckoo_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fp.cuckoo_stats(cuckoo_fingerprints(spark, d), CUCKOO))


def quotient_set(spark: SparkSession, d: str) -> DataFrame:
    return fp.build(_small_parts(spark, d), _key("p_partkey"), QUOTIENT)


def quotient_contains(spark: SparkSession, d: str) -> DataFrame:
    return fp.with_contains(table(spark, d, "part").select("p_partkey"), _key("p_partkey"), quotient_set(spark, d), QUOTIENT)


def quotient_remove(spark: SparkSession, d: str) -> DataFrame:
    return fp.remove(quotient_set(spark, d), table(spark, d, "part").where("p_size <= 5"), _key("p_partkey"), QUOTIENT)


def quotient_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fp.quotient_stats(quotient_set(spark, d), QUOTIENT))


def quotient_layout(spark: SparkSession, d: str) -> DataFrame:
    """The whole table, in a filter that grows with its rows from the smallest size on."""
    suppliers = table(spark, d, "supplier")
    bits = max(QUOTIENT_SMALL.quotient_bits, params.quotient_bits(suppliers.count() or 1))
    spec = fp.QuotientSpec(bits, QUOTIENT_SMALL.remainder_bits)
    return fp.quotient_layout(fp.build(suppliers, _key("s_suppkey"), spec), spec)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return cms.build(table(spark, d, "lineitem"), _key("l_suppkey"), GRID, F.col("l_quantity").cast("bigint"))


def cms_grid(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)


def _estimates(spark: SparkSession, d: str, name: str) -> DataFrame:
    keys = table(spark, d, "supplier").select("s_suppkey")
    return cms.estimate(keys, _key("s_suppkey"), _lines(spark, d), GRID, {"estimate": cms.STRATEGIES[name]})


def cms_min(spark: SparkSession, d: str) -> DataFrame:
    return _estimates(spark, d, "min")


def cms_mean(spark: SparkSession, d: str) -> DataFrame:
    return _estimates(spark, d, "mean")


def cms_median_bias(spark: SparkSession, d: str) -> DataFrame:
    return _estimates(spark, d, "median_bias")


def cms_remove(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return cms.removed(_lines(spark, d), gone, _key("l_suppkey"), GRID, F.col("l_quantity").cast("bigint"))


def cms_heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    return cms.heavy_hitters(table(spark, d, "events"), _key("user_id"), GRID, 20)


def _events(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    return hll.build(table(spark, d, "events"), _key("user_id"), P, by)


def hll_registers(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, ["event_type"])


def hll_by_group(spark: SparkSession, d: str) -> DataFrame:
    return hll.estimate(_events(spark, d, ["event_type"]), P, ["event_type"])


def hll_merge(spark: SparkSession, d: str) -> DataFrame:
    """The union of two tables' keys, from sketches of each."""
    lines = hll.build(table(spark, d, "lineitem"), _key("l_orderkey"), P)
    orders = hll.build(table(spark, d, "orders"), _key("o_orderkey"), P)
    return hll.estimate(hll.merge(lines, orders), P)


def hll_rollup(spark: SparkSession, d: str) -> DataFrame:
    flags = hll.build(table(spark, d, "lineitem"), _key("l_partkey"), P, ["l_returnflag", "l_linestatus"])
    return hll.rollup(flags, P, ["l_returnflag", "l_linestatus"]).withColumn("level", F.col("level").cast("bigint"))


def hll_vs_exact(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    return hll_by_group(spark, d).join(exact, "event_type")


def hll_daily_window(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming import windowed_registers

    days = windowed_registers(table(spark, d, "events"), "ts", _key("user_id"), P, "1 day")
    return hll.estimate(days, P, ["window_start"]).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "estimate")


def shingles(spark: SparkSession, d: str) -> DataFrame:
    return similarity.shingle_counts(table(spark, d, "documents"), "doc_id", "text", WIDTH)


def _neighbours(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each document beside the next one."""
    return a.join(b, F.col("doc_a") + 1 == F.col("doc_b"))


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    docs = table(spark, d, "documents")
    pairs = _neighbours(docs.select(F.col("doc_id").alias("doc_a"), F.col("text").alias("a")), docs.select(F.col("doc_id").alias("doc_b"), F.col("text").alias("b")))
    return pairs.select("doc_a", "doc_b", F.round(similarity.jaccard_of_texts("a", "b", F.lit(WIDTH)), 9).alias("jaccard"))


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    return similarity.min_hashes(table(spark, d, "documents"), "doc_id", "text", WIDTH, HASHES)


def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    return _signatures(spark, d).select("doc_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


def minhash_similarity(spark: SparkSession, d: str) -> DataFrame:
    s = similarity.dealt(_signatures(spark, d), "doc_id")
    pairs = _neighbours(s.select(F.col("doc_id").alias("doc_a"), F.col("signature").alias("a")), s.select(F.col("doc_id").alias("doc_b"), F.col("signature").alias("b")))
    return pairs.select("doc_a", "doc_b", F.round(similarity.signature_similarity(F.col("a"), F.col("b"), HASHES), 9).alias("similarity"))


def simhash_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return similarity.sim_hashes(table(spark, d, "documents"), "doc_id", "text", WIDTH)


def simhash_hamming(spark: SparkSession, d: str) -> DataFrame:
    s = similarity.dealt(simhash_fingerprint(spark, d), "doc_id")
    pairs = _neighbours(s.select(F.col("doc_id").alias("doc_a"), F.col("sim_hash").alias("a")), s.select(F.col("doc_id").alias("doc_b"), F.col("sim_hash").alias("b")))
    return pairs.select("doc_a", "doc_b", similarity.hamming(F.col("a"), F.col("b")).cast("bigint").alias("distance"))


def simhash_candidates(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similar_candidates(simhash_fingerprint(spark, d), "doc_id", 3)


BLOOM_LAYERS, CUCKOO_LAYERS = ordered.ScalableBloom(100, 0.01), ordered.ScalableCuckoo(8, 0.01)


def _grown_bloom(spark: SparkSession, d: str) -> DataFrame:
    """The order numbers of small line items, in every shard a filter that grows."""
    some = table(spark, d, "lineitem").where("l_quantity <= 20")
    return ordered.grow(some, "l_orderkey", "l_orderkey", lambda: ordered.ScalableBloom(100, 0.01))


def _grown_cuckoo(spark: SparkSession, d: str) -> DataFrame:
    return ordered.grow(table(spark, d, "orders").where("o_orderstatus <> 'P'"), "o_orderkey", "o_orderkey", lambda: ordered.ScalableCuckoo(8, 0.01))


def scalable_bloom_layers(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ordered.layers(_grown_bloom(spark, d), BLOOM_LAYERS))


def scalable_bloom_contains(spark: SparkSession, d: str) -> DataFrame:
    return ordered.with_contains(table(spark, d, "orders").select("o_orderkey"), _key("o_orderkey"), _grown_bloom(spark, d), BLOOM_LAYERS)


def scalable_cuckoo_layers(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ordered.layers(_grown_cuckoo(spark, d), CUCKOO_LAYERS))


def scalable_cuckoo_contains(spark: SparkSession, d: str) -> DataFrame:
    return ordered.with_contains(table(spark, d, "orders").select("o_orderkey"), _key("o_orderkey"), _grown_cuckoo(spark, d), CUCKOO_LAYERS)


def scalable_cuckoo_remove(spark: SparkSession, d: str) -> DataFrame:
    """The pairs left of each layer without the urgent orders."""
    gone = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    left = ordered.remove(_grown_cuckoo(spark, d), gone, _key("o_orderkey"), CUCKOO_LAYERS)
    return ordered.layers(left, CUCKOO_LAYERS).select("shard", "layer", "held", "overflow")


#: So few that bits meet and old customers fade.
DEDUP_BITS = 8


def _dedup(spark: SparkSession, d: str, rule: str) -> DataFrame:
    return ordered.deduplicate(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", DEDUP_BITS, 0.01, rule)


def bs_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _dedup(spark, d, "bs")


def bssd_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _dedup(spark, d, "bssd")


def rlbs_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _dedup(spark, d, "rlbs")


NAMES = """
bloom_words bloom_stats bloom_probe bloom_probe_by_join bloom_semijoin bloom_union bloom_intersect bloom_by_group pbloom_stats pbloom_probe
cuckoo_fingerprints cuckoo_contains cuckoo_remove cuckoo_stats quotient_set quotient_contains quotient_remove quotient_stats quotient_layout
cms_grid cms_min cms_mean cms_median_bias cms_remove cms_heavy_hitters
hll_registers hll_by_group hll_merge hll_rollup hll_vs_exact hll_daily_window
shingles jaccard_pairs minhash_signature minhash_similarity simhash_fingerprint simhash_hamming simhash_candidates
scalable_bloom_layers scalable_bloom_contains scalable_cuckoo_layers scalable_cuckoo_contains scalable_cuckoo_remove bs_dedup bssd_dedup rlbs_dedup
""".split()
QUERIES = {name: globals()[name] for name in NAMES}
