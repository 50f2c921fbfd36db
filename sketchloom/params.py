"""Sizes of sketches: plain formulas, evaluated once on the driver, with validation."""

from __future__ import annotations

import math

LN2 = math.log(2)


def _share(x: float, name: str) -> float:
    if not 0 < x < 1:
        raise ValueError(f"{name} must lie strictly between 0 and 1, not {x}")
    return x


def _positive(x: float, name: str) -> float:
    if not x > 0:
        raise ValueError(f"{name} must be positive, not {x}")
    return x


# Bloom filters


def bloom_hashes(bits: int, items: float) -> int:
    """Best number of hashes for so many bits and items."""
    return max(1, math.ceil(_positive(bits, "bits") / _positive(items, "items") * LN2))


def bloom_bits(items: int, fpp: float) -> int:
    """Bits for so many items at a false positive probability."""
    return math.ceil(-math.log2(_share(fpp, "fpp")) * _positive(items, "items") / LN2)


def bloom_items(bits: int, fpp: float) -> int:
    """Items that so many bits hold at a false positive probability."""
    return -math.floor(LN2 * _positive(bits, "bits") / math.log2(_share(fpp, "fpp")))


def partition_hashes(fpp: float) -> int:
    return math.ceil(math.log2(1 / _share(fpp, "fpp")))


def partition_bits(items: int, fpp: float) -> int:
    """Bits of each partition."""
    return math.ceil(_positive(items, "items") * math.log(_share(fpp, "fpp")) / -(LN2**2) / partition_hashes(fpp))


def dedup_hashes(fpp: float) -> int:
    """Partitions of the stream de-duplication filters."""
    return math.ceil(((1 + math.log(_share(fpp, "fpp")) / math.log(1 - 1 / math.e)) + 1) / 2)


# Fingerprint filters


def next_power(n: int) -> int:
    return 1 << max(0, math.ceil(n) - 1).bit_length()


def cuckoo_buckets(items: int, entries: int) -> int:
    return next_power(math.ceil(_positive(items, "items") / _positive(entries, "entries")))


def cuckoo_fingerprint_bits(fpp: float, entries: int) -> int:
    """Least width whose false positive probability stays within ``fpp``."""
    return math.ceil(math.log2(2 / (1 - (1 - _share(fpp, "fpp")) ** (1 / (2 * entries)))))


def cuckoo_entries(fpp: float, fingerprint_bits: int) -> int:
    """Most entries a bucket may have for ``fpp`` at that width."""
    f = 2.0 ** check_fingerprint_bits(fingerprint_bits)
    entries = math.floor(math.log(1 - _share(fpp, "fpp"), (f - 2) / (f - 1)) / 2)
    if entries < 1:
        raise ValueError("fingerprints this short cannot reach the probability")
    return entries


def check_fingerprint_bits(bits: int, most: int = 64) -> int:
    if not 1 < bits <= most:
        raise ValueError(f"fingerprint bits must lie in 2..{most}, not {bits}")
    return bits


def quotient_bits(capacity: int) -> int:
    """Slots for the capacity at an ideal load of three quarters."""
    return math.ceil(math.log2(1.33 * _positive(capacity, "capacity")))


def remainder_bits(fpp: float) -> int:
    return max(1, math.ceil(math.log2(1 / (-2 * math.log(1 - _share(fpp, "fpp"))))))


# Count-min and distinct counting


def cms_rows(delta: float) -> int:
    return math.ceil(math.log(1 / _share(delta, "delta")))


def cms_cols(epsilon: float) -> int:
    return math.ceil(math.e / _share(epsilon, "epsilon"))


def hll_precision(error: float) -> int:
    """Index bits whose standard error 1.04 / sqrt(2^p) stays within ``error``, held to 4..16."""
    return min(16, max(4, math.ceil(math.log2((1.04 / _share(error, "error")) ** 2))))


def hll_alpha(p: int) -> float:
    if not 4 <= p <= 16:
        raise ValueError(f"precision must lie in 4..16, not {p}")
    return {4: 0.673, 5: 0.697, 6: 0.709}.get(p, 0.7213 / (1 + 1.079 / (1 << p)))
