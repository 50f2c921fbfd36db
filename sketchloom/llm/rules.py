"""Host-level quality rules with empirical-Bayes shrinkage.

Each document is measured and held against document rules.  Rule failures are summed by host,
the hosts' failure rates are shrunk towards a beta prior fitted to all hosts by the method of
moments (weighted by size), and a host whose shrunk rate exceeds ``host_limit`` loses all its documents.
Failures are counted map-side first, so a host with a third of all rows costs one partial row per
task; verdicts return by a join whose small side is broadcast only after it was counted.

Defined results: a null text has no words, so it fails; a null host is a host of its own; repeated
rows each count; an empty table gives an empty result; extra columns are ignored (kept by ``apply_rules``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh_name, join_checked, per_batch, texts_of, tune

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
WINDOW = 5


@dataclass(frozen=True)
class RuleLimits:
    least_words: int = 10
    repeat_percent: int = 20
    symbols_percent: int = 10
    dup_lines: int = 3
    #: A host goes when its shrunk failure rate exceeds this.
    host_limit: float = 0.5


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that the text holds twice or more, first ones included; exact."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    if size == n:
        return 0
    m = n - WINDOW + 1
    if size <= 6_200:  # 6200^5 < 2^63: five ids in one integer
        codes = ids[:m].copy()
        for k in range(1, WINDOW):
            codes *= size
            codes += ids[k : k + m]
    else:  # pairs first, renumbered, so that each step fits
        pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1].astype(np.int64)
        four = np.unique(pair[:-2] * (pair.max() + 1) + pair[2:], return_inverse=True)[1].astype(np.int64)
        codes = four[:m] * size + ids[WINDOW - 1 :]
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(codes, twice))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes split on exactly the six ASCII spaces
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def measure_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (columns doc_id, text, host) without the text, with the five measures."""
    tune(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(t) for t in texts_of(b, empty=None)]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "host", *names])

    src = docs.select("doc_id", "text", "host")
    return per_batch(src, run, f"doc_id {dict(src.dtypes)['doc_id']}, host string, " + ", ".join(f"{x} long" for x in names))


def base_failed(limits: RuleLimits) -> Column:
    return (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))


def any_failed(limits: RuleLimits) -> Column:
    """The host's rules: the base ones, symbols and repeated lines."""
    return base_failed(limits) | (100 * F.col("n_symbols") > limits.symbols_percent * F.col("word_chars")) | (F.col("n_dup_lines") > limits.dup_lines)


def host_rates(measured: DataFrame, limits: RuleLimits, scratch: Scratch) -> DataFrame:
    """host, n, failed, rate, shrunk: the posterior mean under the fitted beta prior.

    The hosts' counts are written once, so that ``measured`` is computed once for them and their moments.

    Moments over hosts weighted by size: mean m and between-host variance v less the binomial
    part; alpha + beta = m (1 - m) / v - 1, held to [1, 10^6], so that without any spread
    every host gets the common rate.
    """
    hosts = scratch.keep(measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(any_failed(limits).cast("long")).alias("failed")))
    rate = F.col("failed") / F.col("n")
    moments = hosts.agg(
        F.sum("failed").alias("f"), F.sum("n").alias("t"), F.count("*").alias("h"), F.sum(rate * F.col("failed")).alias("rf")
    ).select(
        (F.col("f") / F.col("t")).alias("m"),
        (F.col("rf") / F.col("t") - F.pow(F.col("f") / F.col("t"), F.lit(2))).alias("v"),
        (F.col("h") / F.col("t")).alias("inv"),
    )
    m, noise = F.col("m"), F.col("m") * (1 - F.col("m")) * F.col("inv")
    between = F.greatest(F.col("v") - noise, F.lit(1e-12))
    weight = F.greatest(F.lit(1.0), F.least(F.lit(1e6), m * (1 - m) / between - 1))
    prior = moments.select(m.alias("m"), weight.alias("w"))
    o = prior.select(F.struct("m", "w")).scalar()
    return hosts.select("host", "n", "failed", rate.alias("rate"), ((F.col("failed") + o["m"] * o["w"]) / (F.col("n") + o["w"])).alias("shrunk"))


def host_key(host: Column, name: str) -> list[Column]:
    """Two columns that tell all hosts apart, a null one too: whether it is null, and its name."""
    return [host.isNull().alias(f"{name}_none"), F.coalesce(host, F.lit("")).alias(name)]


def rejected_hosts(measured: DataFrame, limits: RuleLimits, scratch: Scratch, name: str) -> DataFrame:
    """One row for each rejected host: the columns of ``host_key`` under ``name``."""
    hosts = host_rates(measured, limits, scratch).where(F.col("shrunk") > limits.host_limit)
    return scratch.keep(hosts.select(*host_key(F.col("host"), name)))


def verdicts(docs: DataFrame, limits: RuleLimits | None = None, host: str = "source") -> DataFrame:
    """Per document: measures, base_failed, kept."""
    limits = limits or RuleLimits()
    scratch = Scratch(docs.sparkSession, "rules")
    src = docs.select(docs["doc_id"], docs["text"], docs[host].cast("string").alias("host"))
    measured = scratch.keep(measure_documents(src))
    bad = rejected_hosts(measured, limits, scratch, "_host").withColumn("_bad", F.lit(True))
    out = join_checked(measured.select("*", *host_key(F.col("host"), "_host")), bad, ["_host_none", "_host"], "left")
    kept = ~F.col("base_failed") & F.col("_bad").isNull()
    return out.withColumn("base_failed", base_failed(limits)).withColumn("kept", kept).drop("_host_none", "_host", "_bad", "host")


def apply_rules(docs: DataFrame, limits: RuleLimits | None = None, host: str = "source") -> DataFrame:
    """The documents that pass, with all their columns, whatever these are called.

    Texts are measured twice (once for the hosts, once for the filter) rather than shuffled. Defined results are the module's:
    a null text goes, documents without a host stand or fall together, repeated rows stay repeated, an empty table stays empty.
    """
    limits = limits or RuleLimits()
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "rules")
    src = docs.select(docs["doc_id"], docs["text"], docs[host].cast("string").alias("host"))
    name = fresh_name(docs, "_host", "_none")
    bad = rejected_hosts(measure_documents(src), limits, scratch, name)
    i = docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for t in b.column(i).to_pylist():
            n, _, _, _, r = measure(t)
            keep.append(n >= limits.least_words and 100 * r <= limits.repeat_percent * n)
        return b.filter(pa.array(keep, pa.bool_()))

    passed = per_batch(docs, run, docs.schema)
    on = [f"{name}_none", name]
    return join_checked(passed.select("*", *host_key(passed[host].cast("string"), name)), bad, on, "left_anti").drop(*on)
