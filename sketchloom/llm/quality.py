"""Quality classifier by importance resampling.

Target text (labelled good) and raw text (every document) are modelled as hashed n-grams of token
shapes; a document's log weight is the log ratio of the two models, averaged over its n-grams and
scaled by ``temperature`` so that length does not decide.  Documents are then resampled without
replacement: Gumbel noise, a fixed function of the id, is added to each log weight and the top k are kept,
k being the number of documents whose log weight lies on the good side of the labelled ones.

The default temperature of 64 multiplies a mean, and the noise has a deviation of 1.28, so it decides only within about 0.02 of the
cut: the filter is then close to a threshold with a blurred edge (``flipped`` counts the documents that the noise moved across it).
A low temperature makes it a real sample: at a temperature t, documents are kept as if drawn without replacement
in proportion to exp(t * mean log ratio).

Only labels are sampled: ``label_rows`` rows, the smallest by a hash of their id.  The raw model, k and the
kth value cover all documents.  The kth value is found from counts in 2^16 bins, twice, so no
sort and nothing that grows with the input reaches the driver.

Defined results: a null or wordless text has log weight -inf and is rejected unless all are; equal
perturbed weights at the kth place are all kept; a null id draws its noise from the text; repeated rows
share one fate; a labelled id that repeats counts by the mean of its rows' weights; without labels of both kinds everything is
kept; an empty table gives an empty result; extra columns are ignored (kept by ``keep_good``).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KNOWN_WORDS, Scratch, per_batch, trim, tune

BUCKET_BITS = 14
MIX = np.uint64(0x9E3779B97F4A7C15)
PIECE = 12
RUNS = re.compile(r"(.)\1\1+")


@dataclass(frozen=True)
class QualityConfig:
    #: Bound of the labelled sample.
    label_rows: int = 4_000
    temperature: float = 64.0
    seed: int = 17


class _Classes(dict):
    """Character classes: lower, upper, digit, other letters; ASCII symbols stand for themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        got = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c if code < 128 else "x"
        self[code] = got
        return got


class Featurizer:
    """Hashed n-grams (1 to 3) of token shapes; a token equal to the one before has a shape of its own.

    A shape of more than ``PIECE`` characters is cut into pieces of that length, which all count, as if they were tokens.
    """

    def __init__(self, most: int = KNOWN_WORDS):
        self.classes, self.known, self.most = _Classes(), {}, most

    def _shape(self, w: str) -> int | np.ndarray:
        """One hash, or those of the pieces."""
        shape = RUNS.sub(r"\1\1", w.translate(self.classes))
        if len(shape) <= PIECE:
            return zlib.crc32(shape.encode())
        return np.array([zlib.crc32(shape[i : i + PIECE].encode()) for i in range(0, len(shape), PIECE)], np.uint64)

    def buckets(self, text: str | None) -> np.ndarray:
        words = text.split() if text else []
        if not words:
            return np.empty(0, np.int64)
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = self._shape(w)
        n = len(words)
        again = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), bool, n - 1)
        try:
            s = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        except (TypeError, ValueError):  # some are in pieces
            made = [np.atleast_1d(np.asarray(known[w], np.uint64)) for w in words]
            s, again = np.concatenate(made), np.repeat(np.append(False, again), [len(x) for x in made])[1:]
            n = len(s)
        s[1:][again] ^= np.uint64(0x5BD1E995)
        grams = [s + np.uint64(1)]
        if n > 1:
            two = s[:-1] * np.uint64(31) + s[1:]
            grams.append(two + np.uint64(2))
        if n > 2:
            grams.append(two[:-1] * np.uint64(31) + s[2:] + np.uint64(3))
        return ((np.concatenate(grams) * MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass(frozen=True)
class QualityModel:
    log_ratio: np.ndarray
    threshold: float  # on the scaled log weight
    config: QualityConfig

    def weight(self, buckets: np.ndarray) -> float:
        return float(self.log_ratio[buckets].mean()) * self.config.temperature if len(buckets) else -np.inf

    def gumbel(self, doc_id, text: str | None) -> float:
        key = f"{self.config.seed}:{doc_id}" if doc_id is not None else f"{self.config.seed}:text:{text}"
        u = (zlib.crc32(key[::-1].encode(), zlib.crc32(key.encode())) * 2654435761 % 2**32 + 0.5) / 2**32
        return float(-np.log(-np.log(u)))


def _counts(docs: DataFrame) -> np.ndarray:
    """Bucket counts by class (target, raw) of ``docs`` (text, quality): summed in each task, then by bucket; one count for a batch."""
    featurizer, size = Featurizer(), 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for b in batches:
            made: tuple[list, list] = ([], [])  # target, others
            for t, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made[q != 1].append(featurizer.buckets(t))
            counted = [np.bincount(np.concatenate(m), minlength=size) if m else 0 for m in made]
            total[0] += counted[0]
            total[1] += counted[0] + counted[1]
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "target", "raw"])
        featurizer.known.clear()
        trim()

    summed = docs.mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    out = np.zeros((2, size))
    for r in summed.collect():  # at most 2^14 rows
        out[:, r[0]] = r[1], r[2]
    return out


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig | None = None) -> QualityModel:
    """Raw counts over every document; target counts and the threshold from the labelled sample."""
    config = config or QualityConfig()
    spark = docs.sparkSession
    tune(spark)
    sample = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.label_rows).collect()
    held = spark.createDataFrame([(r[0], r[1]) for r in sample], "doc_id long, quality int")  # bounded by label_rows
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(F.broadcast(held), "doc_id", "left").select("text", "quality", "doc_id")
    target, raw = _counts(texts)
    size = len(raw)
    ratio = np.log((target + 1) / (target.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))
    model = QualityModel(ratio, -np.inf, config)
    featurizer = Featurizer()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        w = [model.weight(featurizer.buckets(t)) for t in b.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(w)], names=["quality", "doc_id", "weight"])

    scored = per_batch(texts.where("quality IS NOT NULL"), run, "quality int, doc_id long, weight double", featurizer.known)
    # at most label_rows rows, however often an id repeats
    scored = scored.groupBy("doc_id", "quality").agg(F.avg("weight").alias("weight")).select("quality", "weight").collect()
    good, bad = (np.array([r[1] for r in scored if r[0] == q]) for q in (1, 0))
    return QualityModel(ratio, best_threshold(good, bad), config)


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the fewest errors, a lost good document counting ten times; midway in the gap."""
    if not len(good) or not len(bad):
        return -np.inf
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = cuts[np.isfinite(cuts)]
    if not len(cuts):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    cost = 10 * np.searchsorted(good, cuts) + (len(bad) - np.searchsorted(bad, cuts))
    i = int(np.argmin(cost))
    return float((cuts[i] + cuts[i - 1]) / 2 if i else cuts[i])


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, log_weight, perturbed (float): both finite or -inf."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2^14 numbers
    featurizer = Featurizer()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shipped.value
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        w = [m.weight(featurizer.buckets(t)) for t in texts]
        g = [x + m.gumbel(d, t) for x, d, t in zip(w, ids, texts, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(w), pa.array(g, pa.float32())], names=["doc_id", "log_weight", "perturbed"])

    src = docs.select("doc_id", "text")
    return per_batch(src, run, f"doc_id {dict(src.dtypes)['doc_id']}, log_weight double, perturbed float", featurizer.known)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """32-bit floats as unsigned integers in the same order."""
    bits = np.asarray(x, np.float32).view(np.uint32).astype(np.int64)
    return np.where(bits >> 31, 2**32 - 1 - bits, bits + 2**31)


def kth_largest(values: DataFrame, k: int) -> float:
    """Exact kth largest of column ``perturbed`` (float): counts by high, then by low, 16 bits of its order."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ordered_bits(b.column(0).to_numpy(zero_copy_only=False)))], names=["o"])

    orders = per_batch(values.select("perturbed"), run, "o long")
    high = 0
    for shift, rows in ((16, orders), (0, None)):
        rows = rows if rows is not None else orders.where(F.shiftright("o", 16) == high)
        bins = rows.groupBy((F.shiftright("o", shift) % 65536).alias("bin")).count().collect()  # at most 2^16 rows
        for b, c in sorted(((r[0], r[1]) for r in bins), reverse=True):
            if k <= c:
                high = (high << 16) + b
                break
            k -= c
    bits = high - 2**31 if high >= 2**31 else 2**32 - 1 - high
    return float(np.array([bits], np.uint32).view(np.float32)[0])


def select(docs: DataFrame, model: QualityModel, scratch: Scratch) -> tuple[DataFrame, float]:
    """Scores of all documents and the perturbed weight of the kth: rows at or above it are kept."""
    scored = scratch.keep(score(docs, model))
    k = scored.where(F.col("log_weight") >= F.lit(model.threshold)).count()
    return scored, kth_largest(scored, k) if k else float("inf")


def flipped(classified: DataFrame, model: QualityModel) -> DataFrame:
    """One row, lost and won: documents on the good side of the threshold that were not drawn, and others that were."""
    good = F.col("log_weight") >= F.lit(model.threshold)
    return classified.agg(F.count_if(good & ~F.col("kept")).alias("lost"), F.count_if(~good & F.col("kept")).alias("won"))


def classify(docs: DataFrame, labels: DataFrame, config: QualityConfig | None = None) -> DataFrame:
    """doc_id, log_weight, perturbed, kept."""
    scored, least = select(docs, fit(docs, labels, config), Scratch(docs.sparkSession, "quality"))
    return scored.withColumn("kept", F.col("perturbed") >= F.lit(least).cast("float"))


def keep_good(docs: DataFrame, labels: DataFrame, config: QualityConfig | None = None) -> DataFrame:
    """The documents that are kept, with all columns; each is scored again instead of joined back."""
    spark = docs.sparkSession
    model = fit(docs, labels, config)
    _, least = select(docs, model, Scratch(spark, "quality"))
    shipped, featurizer, floor = spark.sparkContext.broadcast(model), Featurizer(), np.float32(least)
    i, j = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shipped.value
        rows = zip(b.column(i).to_pylist(), b.column(j).to_pylist(), strict=True)
        keep = [bool(np.float32(m.weight(featurizer.buckets(t)) + m.gumbel(d, t)) >= floor) for d, t in rows]
        return b.filter(pa.array(keep, pa.bool_()))

    return per_batch(docs, run, docs.schema, featurizer.known)
