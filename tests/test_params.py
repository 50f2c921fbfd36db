"""Sizes, and hash values fixed by SipHash."""

from __future__ import annotations

import pytest

from sketchloom import params
from sketchloom.hashing import siphash24
from sketchloom.operators.bloom import BloomSpec
from sketchloom.operators.cms import CmsSpec
from sketchloom.operators.fingerprint import CuckooSpec, QuotientSpec
from sketchloom.operators.similarity import sip_fingerprint, sip_items, sip_signature

S1, S2, S3 = "the cat sat on a mat", "the cat sat on the mat", "we all scream for ice cream"


def windows(s: str, w: int = 2) -> list[list[str]]:
    t = s.split(" ")
    return [t[i : i + w] for i in range(len(t) - w + 1)]


def test_bloom_sizes():
    assert (BloomSpec.for_items(10, 0.01).bits, BloomSpec.for_items(10, 0.01).hashes) == (96, 7)
    assert BloomSpec.for_items(100, 0.01).bits == 959
    assert BloomSpec.for_bits_and_fpp(100, 0.01).hashes == 7
    assert BloomSpec.for_bits_and_items(100, 10).hashes == 7
    p = BloomSpec.partitioned_for_items(10, 0.01)
    assert (p.bits, p.partition_bits, p.hashes) == (98, 14, 7)
    assert BloomSpec.partitioned_for_items(100, 0.01).bits == 959
    assert BloomSpec.partitioned_for_bits(10, 0.01).bits == 70
    assert not BloomSpec.for_items(10, 0.01).is_empty


def test_dedup_sizes():
    assert [params.dedup_hashes(f) for f in (0.1, 0.05, 0.01, 0.001)] == [4, 5, 7, 9]


def test_fingerprint_sizes():
    c = CuckooSpec.for_items(100)
    assert (c.buckets, c.capacity, c.fingerprint_bits, c.entries) == (32, 128, 8, 4)
    assert CuckooSpec.for_items(100, 16, 8).buckets == 16
    assert [params.cuckoo_fingerprint_bits(f, e) for f, e in ((0.01, 4), (0.005, 4), (0.01, 8), (0.005, 8))] == [11, 12, 12, 13]
    w = CuckooSpec.for_width(100, 0.01, 10)
    assert (w.entries, w.capacity, w.buckets) == (5, 160, 32)
    q = QuotientSpec.for_fpp(100, 0.05)
    assert (q.quotient_bits, q.remainder_bits, q.capacity) == (8, 4, 256)
    for bad in (lambda: CuckooSpec.for_items(100, 1), lambda: CuckooSpec(3), lambda: QuotientSpec(0, 3), lambda: QuotientSpec(40, 20), lambda: params.cuckoo_entries(0.0001, 2)):
        with pytest.raises(ValueError):
            bad()
    assert params.remainder_bits(0.7) == 1


def test_frequency_and_cardinality_sizes():
    s = CmsSpec.for_error(0.1, 0.05)
    assert (s.rows, s.cols) == (3, 28) and s.confidence <= 0.1 and s.error <= 0.05
    assert params.hll_precision(0.01) == 14 and params.hll_precision(1e-5) == 16 and params.hll_precision(0.9) == 4
    with pytest.raises(ValueError):
        params.hll_alpha(17)
    with pytest.raises(ValueError):
        CmsSpec(1, 1)
    for bad in (0, 1, -2):
        with pytest.raises(ValueError):
            params.bloom_bits(10, bad)


def test_siphash_vector():
    # the published test vector: key 00..0f, message 00..0e
    k0, k1 = (int.from_bytes(bytes(range(a, a + 8)), "little") for a in (0, 8))
    assert siphash24(bytes(range(15)), k0, k1) == 0xA129CA6149BE45E5


def test_minhash_of_sentences():
    a, b, c = (sip_signature(windows(s), 100) for s in (S1, S2, S3))
    assert sum(x == y for x, y in zip(a, b, strict=True)) / 100 == 0.49
    assert sum(x == y for x, y in zip(a, c, strict=True)) == 0


def test_simhash_of_sentences():
    a, b, c = (sip_fingerprint(windows(s)) for s in (S1, S2, S3))
    assert bin(a ^ b).count("1") < bin(a ^ c).count("1")


def test_one_item_sets_as_many_bits_as_hashes():
    assert len(set(sip_items(["foo"], 7, 96)[0])) == 7
