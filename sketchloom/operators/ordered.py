"""Filters whose state depends on the order of arrival: growable filters and stream de-duplication filters.

Keys are dealt to shards by hash, and every shard is an independent filter fed in the order of an explicit column.  A shard's rows
are sorted where they lie and streamed through, batch by batch, so a task holds a filter's bits and one batch, never a group.
How many shards there are is part of a filter's definition; tasks follow the session's shuffle partitions.
Random choices are a hash of (seed, shard, step, partition), so a rerun decides alike.  Null keys are skipped.

A grown filter is a table: ``grow`` gives (shard, layer, slots, width, a, b, overflow), one row for each layer with null a and b, then
its content: word number and word of a Bloom layer, fingerprint and smaller bucket of a cuckoo layer.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import WORD, fresh, popcount, unused
from ..hashing import cubic, half, key_of, text_pairs
from ..shipping import ship
from .fingerprint import CuckooSpec

SHARDS = 512


def digest_pair(key: str, seed: str = "") -> tuple[int, int]:
    d = hashlib.md5((seed + key).encode()).hexdigest()
    return int(d[:12], 16), int(d[12:24], 16)


def draw(*parts: object) -> int:
    """A reproducible 48-bit random number."""
    return int(hashlib.md5("/".join(map(str, parts)).encode()).hexdigest()[:12], 16)


class BitLayer:
    """One Bloom filter's bits, with its number of ones kept up to date."""

    def __init__(self, bits: int, hashes: int):
        self.bits, self.hashes, self.ones = bits, hashes, 0
        self.data = bytearray(bits)  # a byte for each bit: single places are read and set quickly

    def places(self, a: int, b: int) -> list[int]:
        return [(a + i * b + cubic(i)) % self.bits for i in range(self.hashes)]

    def contains(self, a: int, b: int) -> bool:
        return all(self.data[p] for p in self.places(a, b))

    def insert(self, a: int, b: int) -> None:
        for p in self.places(a, b):
            self.ones += not self.data[p]
            self.data[p] = 1

    def insert_until_half(self, a: np.ndarray, b: np.ndarray) -> int:
        """Insert hash pairs in their order until half of the bits are set; how many that took.

        A key that is held already sets nothing, so the bits after each key are those of all keys up to it.
        """
        data, n = np.frombuffer(self.data, np.uint8), max(64, self.bits // self.hashes)
        for s in range(0, len(a), n):
            at = np.stack([(a[s : s + n] + i * b[s : s + n] + cubic(i)) % self.bits for i in range(self.hashes)], axis=1)
            flat = at.ravel()
            unset = np.flatnonzero(data[flat] == 0)
            first = unset[np.unique(flat[unset], return_index=True)[1]]
            ones = self.ones + np.cumsum(np.bincount(first // self.hashes, minlength=len(at)))
            half = np.flatnonzero(2 * ones >= self.bits)
            taken = int(half[0]) + 1 if len(half) else len(at)
            data[flat[: taken * self.hashes]] = 1
            self.ones = int(ones[taken - 1])
            if len(half):
                return s + taken
        return len(a)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Indices of the hash pairs that are held."""
        data, left = np.frombuffer(self.data, np.uint8), np.arange(len(a))
        for i in range(self.hashes):
            hit = data[(a + i * b + cubic(i)) % self.bits] == 1
            left, a, b = left[hit], a[hit], b[hit]
        return left

    @property
    def estimated_fpp(self) -> float:
        return (self.ones / self.bits) ** self.hashes


def _without(held: BitLayer | CuckooLayer, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash pairs that a layer does not hold."""
    gone = held.find(a, b)
    return np.delete(a, gone), np.delete(b, gone)


@dataclass
class ScalableBloom:
    """Grows by a layer when half of the last one's bits are set; each layer is larger and stricter than the one before."""

    initial_bits: int
    fpp: float
    growth: float = 2.0
    tightening: float = 0.5
    seed: str = ""
    layers: list[BitLayer] = field(default_factory=list)

    def __post_init__(self):
        params._share(self.fpp, "fpp")
        self.clear()

    def _layer(self, bits: int, fpp: float) -> BitLayer:
        return BitLayer(bits, params.bloom_hashes(bits, params.bloom_items(bits, fpp)))

    def clear(self) -> None:
        self.layers = [self._layer(self.initial_bits, self.fpp)]

    def contains(self, key: str) -> bool:
        a, b = digest_pair(key, self.seed)
        return any(x.contains(a, b) for x in self.layers)

    def insert(self, key: str) -> bool:
        """Whether the key was new."""
        a, b = digest_pair(key, self.seed)
        if any(x.contains(a, b) for x in self.layers):
            return False
        last = self.layers[-1]
        last.insert(a, b)
        self._grow()
        return True

    def _grow(self) -> None:
        last = self.layers[-1]
        if 2 * last.ones >= last.bits:
            self.layers.append(self._layer(math.ceil(last.bits * self.growth), self.fpp * self.tightening ** len(self.layers)))

    def insert_all(self, keys: list[str]) -> None:
        """``insert`` one after the other."""
        a, b = text_pairs(keys, self.seed)
        for x in self.layers[:-1]:
            a, b = _without(x, a, b)
        while len(a):
            last = self.layers[-1]
            taken = last.insert_until_half(a, b)
            a, b = a[taken:], b[taken:]
            self._grow()
            if len(a):
                a, b = _without(last, a, b)

    @property
    def estimated_fpp(self) -> float:
        return 1 - math.prod(1 - x.estimated_fpp for x in self.layers)

    def __len__(self) -> int:
        """Bits of all layers."""
        return sum(x.bits for x in self.layers)

    @property
    def is_empty(self) -> bool:
        """No bits at all, as for a plain filter; a fresh one is not empty."""
        return len(self) == 0

    @property
    def filter_count(self) -> int:
        return len(self.layers)

    @property
    def count_ones(self) -> int:
        return sum(x.ones for x in self.layers)

    @property
    def count_zeros(self) -> int:
        return len(self) - self.count_ones

    def blocks(self) -> Iterator[tuple]:
        """Each layer: its number, slots, width, then arrays of a, b and overflow."""
        for i, x in enumerate(self.layers):
            padded = np.zeros(-(-x.bits // WORD) * WORD, np.uint8)
            padded[: x.bits] = np.frombuffer(x.data, np.uint8)
            words = np.packbits(padded, bitorder="little").view("<u4")
            at = np.flatnonzero(words)
            yield i, x.bits, x.hashes, at, words[at].astype(np.int64), np.zeros(len(at), bool)

    def rows(self) -> Iterator[tuple]:
        """(layer, slots, width, a, b, overflow): a layer's head, then its words."""
        return _rows(self.blocks())


def _rows(blocks: Iterator[tuple]) -> Iterator[tuple]:
    for *shape, a, b, overflow in blocks:
        yield *shape, None, None, False
        for row in zip(a.tolist(), b.tolist(), overflow.tolist(), strict=True):
            yield *shape, *row


class PairSet:
    """A cuckoo layer's pairs, sorted, for many questions at once: which fingerprints there are decides most of them without a hash.

    ``codes`` holds the rank of the fingerprint times the number of buckets, plus the smaller bucket, of each pair.
    """

    #: Bits of a fingerprint by which most absent ones are told.
    MOST_BITS = 22

    def __init__(self, entries: int, slots: int, width: int, a: np.ndarray, b: np.ndarray, seed: str):
        self.buckets, self.width = slots // entries, width
        self.fps, rank = np.unique(a, return_inverse=True)
        self.codes, self.of = np.unique(rank * self.buckets + b, return_inverse=True)  # of: the place of each given pair in codes
        self.turns = text_pairs([str(x) for x in self.fps.tolist()], seed)[0] % self.buckets
        self.mask = (1 << min(width, self.MOST_BITS)) - 1
        self.there = np.zeros(self.mask + 1, bool)
        self.there[self.fps & self.mask] = True

    def places(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the hash pairs whose pair is held, and its place in ``codes``."""
        fp = fingerprints(a, self.width)
        left = np.flatnonzero(self.there[fp & self.mask])
        if not len(left):
            return left, left
        fp = fp[left]
        rank = np.minimum(np.searchsorted(self.fps, fp), len(self.fps) - 1)
        same = self.fps[rank] == fp
        left, rank = left[same], rank[same]
        one = b[left] % self.buckets
        code = rank * self.buckets + np.minimum(one, one ^ self.turns[rank])
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        same = self.codes[at] == code
        return left[same], at[same]

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.places(a, b)[0]


def fingerprints(a: np.ndarray, width: int) -> np.ndarray:
    low = a & ((1 << width) - 1)
    return np.where(low == 0, 1, low)


class CuckooLayer:
    """A cuckoo table with its real placement: displacements and the overflow of items that found no slot."""

    MOST_KICKS = 512

    #: Draws of slots and sides by layer number and entries: they do not hang on the keys, so all filters of a process share them.
    _drawn: dict[tuple[int, int, str], list[int]] = {}

    def __init__(self, spec: CuckooSpec, number: int = 0):
        self.spec, self.number, self.steps = spec, number, 0
        self.extra: set[tuple[int, int]] = set()
        self.clear()

    def _other(self, fp: int, bucket: int) -> int:
        turn = self.turns.get(fp)
        if turn is None:
            turn = self.turns[fp] = digest_pair(str(fp), self.spec.seed)[0] % self.spec.buckets
        return bucket ^ turn

    def _draw(self, what: str, most: int, step: int) -> int:
        known = self._drawn.setdefault((self.number, most, what), [])
        while len(known) <= step:
            known.append(draw(self.number, len(known), what) % most)
        return known[step]

    def locate(self, key: str) -> tuple[int, int, int]:
        a, b = digest_pair(key, self.spec.seed)
        fp = a % (1 << self.spec.fingerprint_bits) or 1
        one = b % self.spec.buckets
        return fp, one, self._other(fp, one)

    def contains(self, key: str) -> bool:
        fp, i, j = self.locate(key)
        return fp in self.table[i] or fp in self.table[j] or (fp, min(i, j)) in self.extra

    def insert(self, key: str) -> None:
        self._put(*self.locate(key))

    def _put(self, fp: int, i: int, j: int) -> None:
        table, entries = self.table, self.spec.entries
        if fp in table[i] or fp in table[j] or self.extra and (fp, min(i, j)) in self.extra:
            return
        self.pairs = None
        for at in (i, j):
            if len(table[at]) < entries:
                table[at].append(fp)
                self.held += 1
                return
        at = (i, j)[self._draw("side", 2, self.steps)]
        self._draw("slot", entries, self.steps + self.MOST_KICKS)
        slots, turns = self._drawn[self.number, entries, "slot"], self.turns
        for _ in range(self.MOST_KICKS):
            self.steps += 1
            slot = slots[self.steps]
            fp, table[at][slot] = table[at][slot], fp
            at ^= turns[fp]  # known since the pair came
            if len(table[at]) < entries:
                table[at].append(fp)
                self.held += 1
                return
        self.extra.add((fp, min(at, self._other(fp, at))))

    @property
    def is_grown(self) -> bool:
        return bool(self.extra) or self.held == self.spec.capacity

    def insert_until_grown(self, a: np.ndarray, b: np.ndarray) -> int:
        """Insert hash pairs in their order until the table is full or has overflowed; how many that took."""
        n = max(64, self.spec.capacity)
        for s in range(0, len(a), n):
            fps, ones = fingerprints(a[s : s + n], self.spec.fingerprint_bits).tolist(), (b[s : s + n] % self.spec.buckets).tolist()
            for k, (fp, i) in enumerate(zip(fps, ones, strict=True)):
                self._put(fp, i, self._other(fp, i))
                if self.held == self.spec.capacity or self.extra:
                    return s + k + 1
        return len(a)

    def content(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrays of fingerprints, smaller buckets and whether a pair found no slot."""
        extra = sorted(self.extra)
        fps = np.array([fp for held in self.table for fp in held], np.int64)
        at = np.repeat(np.arange(self.spec.buckets), [len(x) for x in self.table])
        low = np.minimum(at, [self._other(fp, i) for fp, i in zip(fps.tolist(), at.tolist(), strict=True)]) if len(fps) else at
        a, b = (np.concatenate([x, np.array([e[k] for e in extra], np.int64)]) for k, x in enumerate((fps, low)))
        return a, b, np.arange(len(a)) >= len(fps)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Indices of the hash pairs that are held."""
        if self.pairs is None:
            self.pairs = PairSet(self.spec.entries, self.spec.capacity, self.spec.fingerprint_bits, *self.content()[:2], self.spec.seed)
        return self.pairs.find(a, b)

    def remove(self, key: str) -> None:
        fp, i, j = self.locate(key)
        for at in {i, j}:
            left = [x for x in self.table[at] if x != fp]
            self.held -= len(self.table[at]) - len(left)
            self.table[at] = left
        self.extra.discard((fp, min(i, j)))
        self.pairs = None

    def __len__(self) -> int:
        """Slots taken; items that found none are beside them."""
        return self.held

    @property
    def is_empty(self) -> bool:
        return len(self) == 0

    @property
    def is_nearly_full(self) -> bool:
        return bool(self.extra)

    def clear(self) -> None:
        self.table: list[list[int]] = [[] for _ in range(self.spec.buckets)]
        self.held = 0  # slots taken
        self.turns: dict[int, int] = {}  # what leads from one bucket of a fingerprint to the other
        self.pairs: PairSet | None = None  # made for questions, until the content changes
        self.extra.clear()

    @property
    def estimated_fpp(self) -> float:
        f = 2.0**self.spec.fingerprint_bits
        return 1 - ((f - 2) / (f - 1)) ** (2 * self.spec.entries * len(self) / self.spec.capacity)


@dataclass
class ScalableCuckoo:
    """Grows by a table once the last one is full or has overflowed; removal reaches every table."""

    initial_items: int
    fpp: float
    growth: float = 2.0
    tightening: float = 0.5
    entries: int = 4
    seed: str = ""
    layers: list[CuckooLayer] = field(default_factory=list)

    def __post_init__(self):
        self.clear()

    def clear(self) -> None:
        self.layers = [CuckooLayer(CuckooSpec.for_fpp(self.initial_items, self.fpp, self.entries, self.seed))]

    def contains(self, key: str) -> bool:
        return any(x.contains(key) for x in self.layers)

    def insert(self, key: str) -> bool:
        if self.contains(key):
            return False
        last = self.layers[-1]
        last.insert(key)
        self._grow()
        return True

    def _grow(self) -> None:
        last = self.layers[-1]
        if last.is_grown:
            n = len(self.layers)
            spec = CuckooSpec.for_fpp(math.ceil(last.spec.capacity * self.growth), self.fpp * self.tightening**n, self.entries, self.seed)
            self.layers.append(CuckooLayer(spec, n))

    def insert_all(self, keys: list[str]) -> None:
        """``insert`` one after the other."""
        a, b = text_pairs(keys, self.seed)
        for x in self.layers[:-1]:
            a, b = _without(x, a, b)
        while len(a):
            last = self.layers[-1]
            taken = last.insert_until_grown(a, b)
            a, b = a[taken:], b[taken:]
            self._grow()
            if len(a):
                a, b = _without(last, a, b)

    def remove(self, key: str) -> None:
        for x in self.layers:
            x.remove(key)

    def __len__(self) -> int:
        return sum(len(x) + len(x.extra) for x in self.layers)

    @property
    def capacity(self) -> int:
        return sum(x.spec.capacity for x in self.layers)

    @property
    def estimated_fpp(self) -> float:
        return 1 - math.prod(1 - x.estimated_fpp for x in self.layers)

    @property
    def is_empty(self) -> bool:
        return len(self) == 0

    @property
    def filter_count(self) -> int:
        return len(self.layers)

    @property
    def entries_per_index(self) -> int:
        return self.entries

    def blocks(self) -> Iterator[tuple]:
        """Each layer: its number, slots, width, then arrays of a, b and overflow."""
        for i, x in enumerate(self.layers):
            yield i, x.spec.capacity, x.spec.fingerprint_bits, *x.content()

    def rows(self) -> Iterator[tuple]:
        """(layer, slots, width, a, b, overflow): a layer's head, then its pairs."""
        return _rows(self.blocks())


class StreamFilter:
    """Stream de-duplication: before a new key's bits are set, random bits are reset, so old keys fade.

    ``bs`` resets a bit in every partition, ``bssd`` one bit in one partition, ``rlbs`` a bit in each partition with the
    chance that the partition's load gives.
    """

    def __init__(self, bits_each: int, fpp: float, rule: str = "bs", seed: str = "", shard: int = 0):
        if rule not in ("bs", "bssd", "rlbs"):
            raise ValueError(f"no such rule: {rule}")
        self.k, self.n, self.rule, self.seed, self.shard, self.step = params.dedup_hashes(fpp), bits_each, rule, seed, shard, 0
        self.clear()

    def clear(self) -> None:
        self.data = bytearray(self.k * self.n)  # a byte for each bit, partition after partition
        self.held = [0] * self.k  # ones of each partition

    def places(self, key: str) -> list[int]:
        a, b = digest_pair(key, self.seed)
        return [i * self.n + (a + i * b + cubic(i)) % self.n for i in range(self.k)]

    def contains(self, key: str) -> bool:
        return all(self.data[p] for p in self.places(key))

    def _reset(self, part: int, bit: int) -> None:
        if self.data[part * self.n + bit]:
            self.data[part * self.n + bit] = 0
            self.held[part] -= 1

    def insert(self, key: str) -> bool:
        """Whether the key is distinct so far; a key held already changes nothing."""
        at = self.places(key)
        if all(self.data[p] for p in at):
            return False
        self.step += 1
        roll = lambda *p: draw(self.seed, self.shard, self.step, *p)
        if self.rule == "bssd":
            self._reset(roll("part") % self.k, roll("bit") % self.n)
        else:
            for i in range(self.k):
                if self.rule == "bs" or roll("chance", i) % self.n < self.held[i]:
                    self._reset(i, roll("bit", i) % self.n)
        for i, p in enumerate(at):
            self.held[i] += not self.data[p]
            self.data[p] = 1
        return True

    def __len__(self) -> int:
        """Bits of all partitions."""
        return len(self.data)

    @property
    def is_empty(self) -> bool:
        """No bits at all; a fresh filter is not empty."""
        return not self.data

    @property
    def ones(self) -> int:
        return sum(self.held)

    @property
    def zeros(self) -> int:
        return len(self) - self.ones

    def dump(self) -> bytes:
        return self.step.to_bytes(8, "little") + np.packbits(np.frombuffer(self.data, np.uint8)).tobytes()

    def load(self, state: bytes) -> StreamFilter:
        self.step = int.from_bytes(state[:8], "little")
        bits = np.unpackbits(np.frombuffer(state, np.uint8, offset=8), count=self.k * self.n)
        self.data, self.held = bytearray(bits.tobytes()), bits.reshape(self.k, self.n).sum(axis=1).tolist()
        return self


def shard_of(key: Column, shards: int) -> Column:
    return (half(key, 1, "shard:") % shards).cast("int")


def _sharded(df: DataFrame, key: Column, order: str, shards: int) -> DataFrame:
    """(_order, _shard, _key): whole shards, sorted."""
    ship(df.sparkSession)
    keyed = df.where(key.isNotNull()).select(F.col(order).alias("_order"), shard_of(key, shards).alias("_shard"), key.alias("_key"))
    return keyed.repartition("_shard").sortWithinPartitions("_shard", "_order", "_key")


GROWN = "shard int, layer int, slots long, width int, a long, b long, overflow boolean"
GROWN_ARROW = pa.schema([("shard", pa.int32()), ("layer", pa.int32()), ("slots", pa.int64()), ("width", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("overflow", pa.bool_())])
#: Rows of a filter that are sent at a time.
SENT = 10_000


def grow(df: DataFrame, key: str, order: str, make, shards: int = SHARDS) -> DataFrame:
    """The filters that the keys grow, one in each shard that gets any, as a table.

    ``make()`` gives an empty ``ScalableBloom`` or ``ScalableCuckoo``.
    """

    def sent(shard: int, held) -> Iterator[pa.RecordBatch]:
        for *shape, a, b, overflow in held.blocks():
            for s in range(0, len(a) + 1, SENT):
                head = int(s == 0)
                some = [np.concatenate([np.zeros(head, x.dtype), x[s : s + SENT]]) for x in (a, b, overflow)]
                n, null = len(some[0]), np.arange(len(some[0])) < head
                cells = [pa.repeat(pa.scalar(v, f.type), n) for v, f in zip((shard, *shape), GROWN_ARROW, strict=False)]
                yield pa.RecordBatch.from_arrays([*cells, *(pa.array(x, pa.int64(), mask=null) for x in some[:2]), pa.array(some[2])], schema=GROWN_ARROW)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for shard, b in _by_shard(batches):
            if shard != now:
                if held is not None:
                    yield from sent(now, held)
                now, held = shard, make()
            keys = b.column(1)
            if len(keys) > 1:  # a key that comes again changes nothing
                keys = keys.filter(pa.concat_arrays([pa.array([True]), pc.not_equal(keys[1:], keys[:-1])]))
            held.insert_all(keys.to_pylist())
        if held is not None:
            yield from sent(now, held)

    return _sharded(df, key_of(key), order, shards).select("_shard", "_key").mapInArrow(fold, GROWN)


def layers(grown: DataFrame, like: ScalableBloom | ScalableCuckoo) -> DataFrame:
    """shard, layer, slots, width, held (ones, or pairs in slots), overflow (pairs without a slot), estimated_fpp; ``like`` is any filter of the kind."""
    by = grown.groupBy("shard", "layer", "slots", "width")
    if isinstance(like, ScalableBloom):
        found = by.agg(F.coalesce(F.sum(popcount(F.col("b"))), F.lit(0)).cast("long").alias("held"), F.lit(0).cast("long").alias("overflow"))
        return found.withColumn("estimated_fpp", F.pow(F.col("held") / F.col("slots"), F.col("width").cast("double")))
    found = by.agg(F.count_if(F.col("a").isNotNull() & ~F.col("overflow")).alias("held"), F.count_if("overflow").alias("overflow"))
    f = F.pow(F.lit(2.0), F.col("width").cast("double"))
    return found.withColumn("estimated_fpp", 1 - F.pow((f - 2) / (f - 1), 2.0 * like.entries * F.col("held") / F.col("slots")))


def summary(grown: DataFrame, like: ScalableBloom | ScalableCuckoo) -> DataFrame:
    """shard, filter_count, slots (bits, or the capacity), held, unset, overflow, is_empty (nothing held), estimated_fpp (of all layers together)."""
    of = layers(grown, like).groupBy("shard").agg(
        F.count("*").alias("filter_count"), F.sum("slots").alias("slots"), F.sum("held").alias("held"), F.sum("overflow").alias("overflow"), F.product(1 - F.col("estimated_fpp")).alias("_p")
    )
    return of.select("shard", "filter_count", "slots", "held", (F.col("slots") - F.col("held")).alias("unset"), "overflow", (F.col("held") + F.col("overflow") == 0).alias("is_empty"), (1 - F.col("_p")).alias("estimated_fpp"))


#: Where a key stands in a shard's order, behind every layer.
_LAST = (1 << 31) - 1
_BESIDE = "shard int, layer int, slots long, width int, a long, b long, overflow boolean, _key string"


class HeldBloom:
    """A Bloom layer read back from its rows."""

    def __init__(self, slots: int, hashes: int, a: np.ndarray, b: np.ndarray):
        self.slots, self.hashes = slots, hashes
        self.words = np.zeros(-(-slots // WORD), np.int64)
        self.words[a] = b

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Indices of the hash pairs that the layer may hold."""
        left = np.arange(len(a))
        for i in range(self.hashes):
            at = (a + i * b + cubic(i)) % self.slots
            hit = (self.words[at >> 5] >> (at & (WORD - 1))) & 1 == 1
            left, a, b = left[hit], a[hit], b[hit]
        return left


def _held(like: ScalableBloom | ScalableCuckoo, rows: pa.Table) -> list:
    """The layers of one shard's rows, the last and largest first."""
    return [made for _, made in _layers_held(like, rows)][::-1]


def _layers_held(like: ScalableBloom | ScalableCuckoo, rows: pa.Table) -> Iterator[tuple]:
    """Of each layer with content the numbers of its content's rows, and the layer to ask."""
    layer, slots, width = (rows.column(c).to_numpy() for c in ("layer", "slots", "width"))
    a, b = (rows.column(c).fill_null(-1).to_numpy() for c in ("a", "b"))  # no word's number and no fingerprint is negative
    for n in np.unique(layer).tolist():
        at = np.flatnonzero((layer == n) & (a >= 0))
        if len(at):
            shape = int(slots[at[0]]), int(width[at[0]])
            yield at, HeldBloom(*shape, a[at], b[at]) if isinstance(like, ScalableBloom) else PairSet(like.entries, *shape, a[at], b[at], like.seed)


def _beside(df: DataFrame, key: Column, grown: DataFrame, shards: int) -> DataFrame:
    """Each shard's filter and then its distinct keys, shard after shard in one task: a key meets its layers without a row for each."""
    ship(df.sparkSession)
    keys = df.where(key.isNotNull()).select(key.alias("_key")).distinct()
    keys = keys.select(shard_of(F.col("_key"), shards).alias("shard"), F.lit(_LAST).alias("layer"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _BESIDE.split(", ")[2:-1])], "_key")
    return grown.select(*GROWN_ARROW.names, F.lit(None).cast("string").alias("_key")).unionByName(keys).repartition("shard").sortWithinPartitions("shard", "layer")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of one shard each."""
    for b in batches:
        shard = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for i, j in pairwise(cuts) if len(shard) else ():
            yield int(shard[i]), b.slice(i, j - i)


def with_contains(df: DataFrame, key: Column, grown: DataFrame, like: ScalableBloom | ScalableCuckoo, shards: int = SHARDS, name: str = "found") -> DataFrame:
    """``df`` with a verdict: whether any layer of the key's shard may hold it; null for a null key.

    Distinct keys go to where their shard's filter lies, which is neither collected nor broadcast; a task holds the layers of one shard.
    """
    unused(df, name)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, held = None, [], None
        for shard, b in _by_shard(batches):
            if shard != now:
                now, rows, held = shard, [], None
            behind = int((b.column(1).to_numpy() != _LAST).sum())
            if behind:
                rows.append(b.slice(0, behind))
            asked = b.column("_key").slice(behind)
            if not len(asked) or not rows and not held:
                continue
            if held is None:
                held, rows = _held(like, pa.Table.from_batches(rows)), []
            if not held:
                continue
            left, hits = np.arange(len(asked)), []
            one, two = text_pairs(asked.to_pylist(), like.seed)
            for x in held:
                hit = x.find(one[left], two[left])
                hits.append(left[hit])
                left = np.delete(left, hit)
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(np.concatenate(hits)))], names=["_key"])

    found = _beside(df, key, grown, shards).mapInArrow(ask, "_key string").select("_key", F.lit(True).alias("_hit"))
    own, other, hit = fresh(df, "_key", "_other", "_hit")
    keyed = df.withColumn(own, key)
    joined = keyed.join(found.select(F.col("_key").alias(other), F.col("_hit").alias(hit)), F.col(own) == F.col(other), "left")
    return joined.select(*[joined[c] for c in df.columns], F.when(F.col(own).isNotNull(), F.coalesce(hit, F.lit(False))).alias(name))


def remove(grown: DataFrame, df: DataFrame, key: Column, like: ScalableCuckoo, shards: int = SHARDS) -> DataFrame:
    """Without the keys' pairs, in every layer; layers themselves stay, and room in earlier ones is not used again."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def left() -> Iterator[pa.RecordBatch]:
            if rows:
                whole = pa.Table.from_batches(rows)
                for at, x, gone in held or ():
                    kept[at] = ~gone[x.of]
                yield from (whole.filter(pa.array(kept)) if held else whole).select(GROWN_ARROW.names).cast(GROWN_ARROW).to_batches(SENT)

        now, rows, held, kept = None, [], None, None
        for shard, b in _by_shard(batches):
            if shard != now:
                yield from left()
                now, rows, held, kept = shard, [], None, None
            behind = int((b.column(1).to_numpy() != _LAST).sum())
            if behind:
                rows.append(b.slice(0, behind))
            asked = b.column("_key").slice(behind)
            if not len(asked) or not rows:
                continue
            if held is None:
                held = [(at, x, np.zeros(len(x.codes), bool)) for at, x in _layers_held(like, pa.Table.from_batches(rows))]
                kept = np.ones(sum(map(len, rows)), bool)
            one, two = text_pairs(asked.to_pylist(), like.seed)
            for _, x, gone in held:
                gone[x.places(one, two)[1]] = True
        yield from left()

    return _beside(df, key, grown, shards).mapInArrow(drop, GROWN)


def deduplicate(df: DataFrame, key: str, order: str, bits_each: int, fpp: float, rule: str = "bs", shards: int = SHARDS, seed: str = "") -> DataFrame:
    """``order``, item (the key as text), shard and is_distinct for every row whose key is not null."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in batches:
            out = []
            for shard, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if shard != now:
                    now, held = shard, StreamFilter(bits_each, fpp, rule, seed, shard)
                out.append(held.insert(k))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1), pa.array(out, pa.bool_())], names=["_order", "item", "shard", "is_distinct"])

    if order in ("item", "shard", "is_distinct"):
        raise ValueError(f"the order column may not be called {order}")
    rows = _sharded(df, key_of(key), order, shards)
    return rows.mapInArrow(fold, f"_order {dict(df.dtypes)[order]}, item string, shard int, is_distinct boolean").withColumnRenamed("_order", order)
