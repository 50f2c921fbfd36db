"""Shingles, exact Jaccard similarity, MinHash signatures, SimHash fingerprints and their sorted-neighbourhood candidates.

Texts are split at single spaces, without normalisation.  A text with fewer tokens than the window has no shingles: it has no
signature and no fingerprint, and its similarity to another such text is null.

Signatures and fingerprints are made where the texts lie, in Arrow batches, from one of two hash providers: ``sql`` (48-bit
halves of an MD5 of the joined window, after ``seed``, which any SQL engine can follow) or ``sip24`` (64-bit SipHash of the window's
tokens under ``keys``, wrapping).  64-bit values come as signed integers of the same bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..hashing import BITS, cubic, halves, md5_digests, sip_hashes, sip_pairs, siphash24_many, text_bytes, tokens_bytes
from ..shipping import tune

#: Hashes held at once while minima are taken.
HELD = 1 << 20
#: Windows that are hashed at a time, and bytes of the texts that are cut into windows together (one text at least).
WINDOWS, TEXT_BYTES = 1 << 17, 1 << 20
PROVIDERS = {"sql": BITS, "sip24": 64}
#: Two pairs of 64-bit words.
SipKeys = tuple[tuple[int, int], tuple[int, int]]
KEYS: SipKeys = ((0, 0), (1, 1))


def tokens(text: Column) -> Column:
    return F.split(text, " ", -1)


def shingles(tokens: Column, width: int) -> Column:
    """array<string>: windows of ``width`` tokens joined by a space, duplicates kept; ``width`` passes over the array.

    The tokens are bound once: inside a lambda their expression would be evaluated again for every window.
    """
    none = F.expr("cast(array() as array<string>)")

    def windows(t: Column) -> Column:
        n = F.size(t) - (width - 1)
        made = F.slice(t, 1, F.greatest(n, F.lit(0)))
        for k in range(1, width):
            made = F.zip_with(made, F.slice(t, k + 1, F.greatest(n, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
        return F.when(n > 0, made).otherwise(none)

    return F.element_at(F.transform(F.array(tokens), windows), 1)


def exploded(docs: DataFrame, doc: str, text: str, width: int) -> DataFrame:
    """(doc, shingle), one row for each window."""
    return docs.select(F.col(doc), F.explode(shingles(tokens(F.col(text)), width)).alias("shingle"))


def shingle_set(text: str, width: int) -> set[tuple[str, ...]]:
    """A text's distinct windows."""
    words = text.split(" ")
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def one_by_one(texts: pa.Array) -> Iterator[str | None]:
    """The texts, of which only one is a Python string at a time."""
    return (t.as_py() for t in texts)


def shingle_counts(docs: DataFrame, doc: str, text: str, width: int) -> DataFrame:
    """(doc, n, n_distinct) of the texts that have shingles; nothing is shuffled.

    In Arrow batches: functions on arrays make every window a string first and take several times as long.
    """
    schema = T.StructType([T.StructField(doc, docs.schema[doc].dataType), T.StructField("n", T.LongType()), T.StructField("n_distinct", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(0, 0) if t is None else (max(0, t.count(" ") + 2 - width), len(shingle_set(t, width))) for t in one_by_one(b.column(1))]
            n, distinct = (pa.array([x[k] for x in made], pa.int64()) for k in range(2))
            out = pa.RecordBatch.from_arrays([b.column(0), n, distinct], names=[doc, "n", "n_distinct"])
            yield out.filter(pc.greater(n, 0))

    tune(docs.sparkSession)
    return docs.select(F.col(doc), F.col(text).alias(f"{doc}_text")).mapInArrow(run, schema)


@F.pandas_udf(T.DoubleType())
def jaccard_of_texts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Columns text, text, width: exact similarity of their shingle sets; null where neither has any."""
    for one, two, width in batches:
        out = []
        for x, y, w in zip(one, two, width, strict=True):
            p, q = (set() if t is None else shingle_set(t, int(w)) for t in (x, y))
            same = len(p & q)
            out.append(same / (len(p) + len(q) - same) if p or q else None)
        yield pd.Series(out, dtype="float64")


def jaccard(one: Column, two: Column) -> Column:
    """|intersection| / |union| of two arrays' distinct elements; null for two empty ones."""
    union = F.size(F.array_union(one, two))
    return F.when(union > 0, F.size(F.array_intersect(one, two)) / union)


def windows_of(text: str | None, width: int) -> list[list[str]]:
    words = [] if text is None else text.split(" ")
    return [words[i : i + width] for i in range(len(words) - width + 1)]


def window_pairs(text: str | None, width: int, seed: str, provider: str, keys: SipKeys = KEYS) -> tuple[np.ndarray, np.ndarray]:
    """The hash pairs of a text's windows, duplicates kept."""
    if provider == "sip24":
        return sip_pairs([tokens_bytes(w) for w in windows_of(text, width)], keys)
    digests = b"".join(hashlib.md5((seed + " ".join(w)).encode()).digest()[:12] for w in windows_of(text, width))
    raw = np.frombuffer(digests, np.uint8).reshape(-1, 2, 6)
    wide = np.zeros((len(raw), 2, 8), np.uint8)
    wide[:, :, 2:] = raw
    both = wide.view(">u8")[:, :, 0].astype(np.uint64)
    return both[:, 0], both[:, 1]


def minima(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The least of each of the first k hashes; a bounded number of hashes is held at a time."""
    step, out = max(1, HELD // k), None
    for s in range(0, len(a), step):
        least = sip_hashes(a[s : s + step], b[s : s + step], k).min(axis=1)
        out = least if out is None else np.minimum(out, least)
    return out


def fingerprint(h: np.ndarray, bits: int) -> int:
    """A place counts +1 for every hash with a 0 there and -1 for a 1; the result has a 1 where the count is not negative, the
    lowest place of the hash first."""
    ones = np.zeros(bits, np.int64)
    for s in range(0, len(h), HELD // 64):
        part = h[s : s + HELD // 64]
        ones += np.array([int(((part >> np.uint64(i)) & np.uint64(1)).sum()) for i in range(bits)])
    out = 0
    for c in len(h) - 2 * ones:
        out = out << 1 | int(c >= 0)
    return out


class Windows:
    """The windows of a column's texts as places in its bytes: tokens are joined by the very spaces that part them."""

    def __init__(self, texts: pa.Array, width: int):
        n, wide = len(texts), pa.types.is_large_string(texts.type)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        self.data = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
        at -= at[0]
        spaces = np.flatnonzero(self.data == 32)
        tokens = np.diff(np.searchsorted(spaces, at)) + 1
        last = np.cumsum(tokens) - 1
        first = last - tokens + 1
        starts, ends, inner = np.empty(len(spaces) + n, np.int64), np.empty(len(spaces) + n, np.int64), np.ones(len(spaces) + n, bool)
        inner[first] = False
        starts[inner], starts[first] = spaces + 1, at[:-1]
        inner[:] = True
        inner[last] = False
        ends[inner], ends[last] = spaces, at[1:]
        self.counts = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.maximum(tokens - width + 1, 0), 0)
        self.texts = np.repeat(np.arange(n), self.counts)
        one = np.arange(len(self.texts)) - np.repeat(np.cumsum(self.counts) - self.counts - first, self.counts)
        self.starts, self.ends = starts[one], ends[one + width - 1]

    def digests(self, seed: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of some windows at a time: texts, where each begins in the digests, and the digests."""
        for s in range(0, len(self.texts), WINDOWS):
            of = self.texts[s : s + WINDOWS]
            begins = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
            yield of[begins], begins, md5_digests(self.data, self.starts[s : s + WINDOWS], self.ends[s : s + WINDOWS], seed.encode())


def column_minima(w: Windows, k: int, seed: str) -> np.ndarray:
    """(texts, k): the minima of each text's windows."""
    out = np.full((len(w.counts), k), np.iinfo(np.int64).max)
    for texts, begins, digests in w.digests(seed):
        h, b = halves(digests)
        for i in range(k):
            out[texts, i] = np.minimum(out[texts, i], np.minimum.reduceat(h, begins) + cubic(i))
            h += b
    return out


def column_fingerprints(w: Windows, seed: str) -> np.ndarray:
    """Each text's fingerprint."""
    ones = np.zeros((len(w.counts), BITS), np.int64)
    for texts, begins, digests in w.digests(seed):
        places = np.unpackbits(digests[:, : BITS // 8], axis=1)  # the highest place first
        # at most 255 rows are added in bytes
        fine = np.unique(np.concatenate([begins, np.arange(0, len(places), 255)]))
        sums = np.add.reduceat(places, fine, axis=0, dtype=np.uint8)
        ones[texts] += np.add.reduceat(sums, np.searchsorted(fine, begins), axis=0, dtype=np.int64)[:, ::-1]
    return (w.counts[:, None] >= 2 * ones) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with texts of ``TEXT_BYTES`` together, or a single longer one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy())
    s = 0
    while s < b.num_rows:
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + TEXT_BYTES, side="right")))
        yield b.slice(s, e - s)
        s = e


def _per_column(docs: DataFrame, doc: str, text: str, name: str, kind: T.DataType, width: int, fn: Callable[[Windows], np.ndarray]) -> DataFrame:
    """(doc, name) of the texts that have windows, many texts at a time; nothing is shuffled."""
    tune(docs.sparkSession)
    schema = T.StructType([T.StructField(doc, docs.schema[doc].dataType), T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in _pieces(b):
                w = Windows(piece.column(1), width)
                made, full = fn(w), w.counts > 0
                made = made[full]
                flat = pa.array(made.ravel(), pa.int64())
                if made.ndim == 2:
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([piece.column(0).filter(pa.array(full)), flat], names=[doc, name])

    return docs.select(F.col(doc), F.col(text).alias(f"{doc}_text")).mapInArrow(run, schema)


def _per_text(docs: DataFrame, doc: str, text: str, name: str, kind: T.DataType, fn: Callable[[str | None], object]) -> DataFrame:
    """(doc, name) of the texts for which ``fn`` gives a value; nothing is shuffled."""
    tune(docs.sparkSession)
    schema = T.StructType([T.StructField(doc, docs.schema[doc].dataType), T.StructField(name, kind)])
    arrow = pa.list_(pa.int64()) if isinstance(kind, T.ArrayType) else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([fn(t) for t in one_by_one(b.column(1))], arrow)
            out = pa.RecordBatch.from_arrays([b.column(0), made], names=[doc, name])
            yield out.filter(made.is_valid())

    return docs.select(F.col(doc), F.col(text).alias(f"{doc}_text")).mapInArrow(run, schema)


def check_provider(provider: str) -> int:
    if provider not in PROVIDERS:
        raise ValueError(f"no such hash provider: {provider}")
    return PROVIDERS[provider]


def min_hashes(docs: DataFrame, doc: str, text: str, width: int, k: int, seed: str = "", provider: str = "sql", keys: SipKeys = KEYS) -> DataFrame:
    """(doc, signature array<bigint>): the k minima over the shingles, for any k."""
    check_provider(provider)
    if k < 1:
        raise ValueError(f"one hash at least, not {k}")
    if provider == "sql" and k * (1 << BITS) + cubic(k) >= 1 << 63:
        raise ValueError(f"sums of {k} hashes of {BITS} bits leave 64 bits; the provider sip24 has no such limit")
    if provider == "sql":
        return _per_column(docs, doc, text, "signature", T.ArrayType(T.LongType()), width, lambda w: column_minima(w, k, seed))

    def made(t: str | None) -> list[int] | None:
        a, b = window_pairs(t, width, seed, provider, keys)
        return minima(a, b, k).view(np.int64).tolist() if len(a) else None

    return _per_text(docs, doc, text, "signature", T.ArrayType(T.LongType()), made)


def signature_similarity(one: Column, two: Column, k: int) -> Column:
    """Share of equal places; null unless both hold k."""
    same = F.aggregate(F.zip_with(one, two, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when((F.size(one) == k) & (F.size(two) == k), same / k)


def sim_hashes(docs: DataFrame, doc: str, text: str, width: int, seed: str = "", provider: str = "sql", keys: SipKeys = KEYS) -> DataFrame:
    """(doc, sim_hash): 48 bits, or 64 from SipHash under the first key."""
    bits = check_provider(provider)
    if provider == "sql":
        return _per_column(docs, doc, text, "sim_hash", T.LongType(), width, lambda w: column_fingerprints(w, seed))

    def made(t: str | None) -> int | None:
        h = siphash24_many([tokens_bytes(w) for w in windows_of(t, width)], *keys[0])
        if not len(h):
            return None
        value = fingerprint(h, bits)
        return value - (1 << 64) if value >> 63 else value

    return _per_text(docs, doc, text, "sim_hash", T.LongType(), made)


def hamming(one: Column, two: Column) -> Column:
    return F.bit_count(one.bitwiseXOR(two))


def dealt(hashed: DataFrame, doc: str) -> DataFrame:
    """``hashed`` dealt out by document, so that a plan which reads it twice reuses the exchange and hashes no text again."""
    return hashed.where(F.col(doc).isNotNull()).repartition(doc)


def similar_candidates(hashed: DataFrame, doc: str, window: int, block_bits: int = 10, bits: int = BITS) -> DataFrame:
    """(doc_a, doc_b): pairs within ``window`` places of each other in the order of some rotation of the fingerprints of so many ``bits``.

    Pairs inside a sliding window are pairs at a rank distance below it.  Ranks are taken inside blocks of leading bits, carried over the
    blocks' counts (a table of at most ``bits * 2^block_bits`` rows), so a rotation is never sorted by one task.
    """
    if window < 2:
        raise ValueError("the window must hold two entries at least")
    rows = hashed.where(F.col("sim_hash").isNotNull()).select(F.col(doc).alias("doc"), "sim_hash").repartition("doc")  # read twice, hashed once
    rotated = rows.withColumn("rot", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    left = F.call_function("shiftleft", F.col("sim_hash"), F.col("rot"))
    right = F.call_function("shiftrightunsigned", F.col("sim_hash"), F.lit(bits) - F.col("rot"))  # at 64 bits a shift by 64 is none
    turned = left.bitwiseOR(right) if bits == 64 else left.bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(right)
    rotated = rotated.select("doc", "rot", turned.alias("h")).withColumn("block", F.shiftrightunsigned("h", bits - block_bits))
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63))) if bits == 64 else F.col("h")
    inside = Window.partitionBy("rot", "block").orderBy(unsigned, "doc")
    ahead = F.array(*[F.lead(F.struct("doc"), n).over(inside) for n in range(1, window)])
    ranked = rotated.select("rot", "block", "doc", F.row_number().over(inside).alias("_r"), ahead.alias("_ahead"))
    met = ranked.select("doc", F.explode(F.filter("_ahead", lambda x: x.isNotNull())).alias("_o")).select("doc", F.col("_o.doc").alias("other"))
    # only a block's first and last rows may be near rows of other blocks: these meet by rank
    edges = ranked.where((F.col("_r") < window) | F.element_at("_ahead", -1).isNull()).select("rot", "block", "doc", "_r").repartition("rot", "_r")
    before = Window.partitionBy("rot").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rotated.groupBy("rot", "block").count().select("rot", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    edges = edges.join(starts, ["rot", "block"]).select("rot", "doc", (F.col("_first") + F.col("_r")).alias("rank"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(window - 1))).alias("_d")
    behind = edges.select("rot", F.col("doc").alias("other"), "rank", steps).select("rot", "other", (F.col("rank") - F.col("_d")).alias("rank"))
    across = edges.join(behind, ["rot", "rank"]).select("doc", "other")
    return met.unionByName(across).select(F.least("doc", "other").alias("doc_a"), F.greatest("doc", "other").alias("doc_b")).distinct()


# SipHash values of windows outside DataFrames.


def sip_signature(windows: list[list[str]], k: int) -> list[int]:
    return [int(x) for x in minima(*sip_pairs([tokens_bytes(w) for w in windows]), k)]


def sip_fingerprint(windows: list[list[str]]) -> int:
    """64 bits; the lowest place of the hashes becomes the highest of the result."""
    return fingerprint(siphash24_many([tokens_bytes(w) for w in windows], 0, 0), 64)


@F.pandas_udf(T.ArrayType(T.DecimalType(20, 0)))
def sip_min_hashes(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Columns text, width, k: unsigned 64-bit minima."""
    from decimal import Decimal

    for text, width, k in batches:
        made = [windows_of(t, int(w)) for t, w in zip(text, width, strict=True)]
        yield pd.Series([[Decimal(x) for x in sip_signature(m, int(n))] if m else None for m, n in zip(made, k, strict=True)])


def sip_items(items: list[str], k: int, bits: int) -> np.ndarray:
    """(items, k) positions of strings in a filter of so many bits."""
    a, b = sip_pairs([text_bytes(s) for s in items])
    return (sip_hashes(a, b, k) % np.uint64(bits)).T
