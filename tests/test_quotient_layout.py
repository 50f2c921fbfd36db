"""The quotient layout of the whole table, against insertion by hand."""

from __future__ import annotations

import hashlib

from sketchloom.plans import catalogue


def laid_out(pairs, bits):
    """Slots of sorted pairs: each at its quotient or right after the one before, the ring walked twice."""
    size, at, out = 1 << bits, -1, {}
    for turn in (0, 1):
        for q, r in sorted(pairs):
            at = max(at + 1, q + turn * size)
            out[q, r] = at % size
    return sorted((slot, q, r) for (q, r), slot in out.items())


def test_every_supplier_is_laid_out(spark):
    d = "/root/testdata/sf0.1"
    keys = [r[0] for r in spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey").collect()]
    halves = [int(hashlib.md5(str(k).encode()).hexdigest()[:12], 16) for k in keys]
    pairs = {((h >> 6) % 2048, h % 64) for h in halves}
    got = sorted((r.slot, r.quotient, r.remainder) for r in catalogue.quotient_layout(spark, d).collect())
    assert len(keys) == 1_000 and got == laid_out(pairs, 11)
