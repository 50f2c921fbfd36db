"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up, then the median of three runs; prints one JSON line.

Each sketch stands beside the exact operator that it approximates; ``shuffle_mb`` has what one run of each query writes to
shuffles, ``errors`` how far sketches are from exact answers (relative for counts, a rate for membership).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

ROOT = Path(__file__).parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sketchloom import plans  # noqa: E402
from sketchloom.sources import table  # noqa: E402

HEADLINE = """
bloom_probe bloom_semijoin pbloom_probe cuckoo_contains quotient_contains quotient_layout cms_min cms_median_bias cms_heavy_hitters
hll_by_group hll_merge hll_rollup shingles jaccard_pairs minhash_signature simhash_fingerprint scalable_bloom_layers scalable_bloom_contains bs_dedup
""".split()


def exact_semijoin(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderstatus")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    return lines.join(urgent, lines.l_orderkey == urgent.o_orderkey).groupBy("o_orderstatus").agg(F.count("*"), F.sum("l_quantity"))


EXACT = {
    "exact_distinct_by_group": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.countDistinct("user_id")),
    "exact_rollup": lambda s, d: table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.countDistinct("l_partkey")),
    "exact_group_counts": lambda s, d: table(s, d, "events").groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(20),
    "exact_semijoin": exact_semijoin,
    "exact_first_seen": lambda s, d: table(s, d, "orders").dropDuplicates(["o_custkey"]),
}


def shuffled(spark: SparkSession) -> float:
    """MB that all stages so far have written to shuffles, as Spark's own status store has them."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) / 1e6


def errors(spark: SparkSession, d: str) -> dict[str, float]:
    """Observed errors of the headline sketches."""
    events, lines, parts = (table(spark, d, t) for t in ("events", "lineitem", "part"))
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))
    users = plans.queries()["hll_by_group"](spark, d).join(exact, "event_type").agg(F.max(F.abs(F.col("estimate") / F.col("n") - 1))).first()[0]
    counts = lines.groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    weights = plans.queries()["cms_min"](spark, d).join(counts, F.col("s_suppkey") == F.col("l_suppkey")).agg(F.max((F.col("estimate") - F.col("n")) / total)).first()[0]
    members = parts.where("p_size <= 25").select("p_partkey").withColumn("member", F.lit(True))
    found = plans.queries()["cuckoo_contains"](spark, d).join(members, "p_partkey", "left").where("member IS NULL").agg(F.avg(F.col("found").cast("double"))).first()[0]
    return {"hll_by_group": round(users, 5), "cms_min_of_total": round(weights, 6), "cuckoo_false_positives": round(found or 0.0, 5)}


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, moved = {}, {}
    for name, f in ({n: plans.queries()[n] for n in HEADLINE} | EXACT).items():
        runs = []
        for i in range(4):
            before = shuffled(spark) if i == 3 else 0.0
            began = time.perf_counter()
            f(spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(median(runs[1:]), 3)
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        moved[name] = round(shuffled(spark) - before, 3)
    missed = errors(spark, d)
    spark.stop()
    sf = Path(d).name.removeprefix("sf")
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took[n] for n in HEADLINE), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "shuffle_mb": moved, "errors": missed}))


if __name__ == "__main__":
    main()
