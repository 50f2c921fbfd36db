"""Hash providers.

``sql``: two 48-bit halves of an MD5, so every engine with MD5 computes the same sketch and no sum
overflows a signed 64-bit integer.  ``xx``: 48 bits of Spark's own xxHash, of a key of any type, many times as fast, for sketches that stay
in Spark.  ``sip24``: SipHash-2-4 pairs with wrapping 64-bit arithmetic, in Arrow batches.

The i-th hash of a key is a + i b + C(i, 3).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 48


def key_of(*columns: str | Column) -> Column:
    """A canonical string key: one column as it prints, several as length-prefixed parts."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    if len(parts) == 1:
        return parts[0].cast("string")
    text = [p.cast("string") for p in parts]
    return F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in text])


def half(key: Column, which: int, seed: str = "") -> Column:
    """48 bits of the key's digest: the first or the second twelve hexadecimal digits."""
    digest = F.md5((F.concat(F.lit(seed), key) if seed else key).cast("binary"))
    return F.conv(F.substring(digest, 1 + 12 * which, 12), 16, 10).cast("bigint")


def pair(key: Column, seed: str = "", provider: str = "sql") -> tuple[Column, Column]:
    """Two 48-bit hashes; null for a null key."""
    if provider == "xx":
        low = F.lit((1 << BITS) - 1)
        one, two = (F.xxhash64(key, F.lit(f"{seed}/{i}")).bitwiseAND(low) for i in range(2))
        return F.when(key.isNotNull(), one), F.when(key.isNotNull(), two)
    if provider != "sql":
        raise ValueError(f"no such hash provider: {provider}")
    return half(key, 0, seed), half(key, 1, seed)


def cubic(i: int) -> int:
    return i * (i - 1) * (i - 2) // 6


def nth(a: Column, b: Column, i: int | Column) -> Column:
    if isinstance(i, int):
        return a + b * i + cubic(i)
    i = i.cast("bigint")
    return a + b * i + F.floor(i * (i - 1) * (i - 2) / 6).cast("bigint")


def hashes(a: Column, b: Column, k: int) -> Column:
    """array<bigint> of the first k hashes."""
    return F.array(*[nth(a, b, i) for i in range(k)])


# The same in Arrow batches. Most strings fit in one block of MD5, and many blocks go through the rounds together.

#: Blocks that are hashed together: their words stay in the processor's caches.
TOGETHER = 1 << 15
#: Fewer are hashed one by one.
FEW = 1_000
#: Bytes of a string that leave room for the end mark and the length in its block.
ROOM = 55
_TURNS = [(np.array([n], np.uint32), np.array([32 - n], np.uint32)) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in four * 4]
_SINES = [np.array([math.floor(abs(math.sin(i + 1)) * 2**32)], np.uint32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_KEPT = np.array([[255 * (i < n) for i in range(64)] for n in range(ROOM + 1)], np.uint8).view("<u8")
_ENDED = np.array([[128 if i == n else (8 * n >> 8 * (i - 56)) & 255 if i >= 56 else 0 for i in range(64)] for n in range(ROOM + 1)], np.uint8).view("<u8")


def _md5_rounds(blocks: np.ndarray) -> np.ndarray:
    """(n, 16) digests of (n, 8) 64-bit words, a block each."""
    x = np.ascontiguousarray(blocks.view("<u4").T)
    a, b, c, d = (np.full(len(blocks), v, np.uint32) for v in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        np.add(a, f, out=a), np.add(a, x[g], out=a), np.add(a, _SINES[i], out=a)
        np.left_shift(a, _TURNS[i][0], out=t), np.right_shift(a, _TURNS[i][1], out=a)
        np.bitwise_or(a, t, out=a), np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return np.stack([v + np.uint32(s) for v, s in zip((a, b, c, d), _START, strict=True)], axis=1).astype("<u4").view(np.uint8)


def md5_digests(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: bytes = b"") -> np.ndarray:
    """(n, 16) bytes: the digests of ``seed`` and the bytes from each start up to its end."""
    out, lengths = np.empty((len(starts), 16), np.uint8), ends - starts
    short = np.zeros(len(starts), bool) if seed or len(starts) < FEW else lengths <= ROOM
    if short.sum() < FEW:
        short[:] = False
    at = np.flatnonzero(short)
    if len(at):
        padded = np.concatenate([flat, np.zeros(64, np.uint8)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, 64)
        for s in range(0, len(at), TOGETHER):
            some = at[s : s + TOGETHER]
            n = lengths[some]
            out[some] = _md5_rounds((windows[starts[some]].view("<u8") & _KEPT[n]) | _ENDED[n])
    rest = np.flatnonzero(~short)
    if len(rest):
        data = flat.tobytes()
        made = b"".join([hashlib.md5(seed + data[i:j]).digest() for i, j in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)])
        out[rest] = np.frombuffer(made, np.uint8).reshape(-1, 16)
    return out


def halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two 48-bit halves of each digest, as signed integers."""
    wide = np.zeros((len(digests), 2, 8), np.uint8)
    wide[:, :, 2:] = digests[:, :12].reshape(-1, 2, 6)
    both = wide.view(">u8")[:, :, 0].astype(np.int64)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def text_pairs(texts: list[str], seed: str = "") -> tuple[np.ndarray, np.ndarray]:
    """``pair`` of many strings."""
    data = [t.encode() for t in texts]
    ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
    starts = np.concatenate([np.zeros(1, np.int64), ends])[:-1]
    return halves(md5_digests(np.frombuffer(b"".join(data), np.uint8), starts, ends, seed.encode()))


# The same in DuckDB's SQL, for oracles.


def duck_half(key: str, which: int, seed: str = "") -> str:
    text = f"('{seed}' || {key})" if seed else key
    return f"('0x' || substr(md5({text}), {1 + 12 * which}, 12))::BIGINT"


def duck_nth(a: str, b: str, i: str) -> str:
    return f"({a} + {i} * {b} + {i} * ({i} - 1) * ({i} - 2) // 6)"


# SipHash-2-4

MASK = (1 << 64) - 1


def siphash24(data: bytes, k0: int, k1: int) -> int:
    """SipHash with two compression and four finalisation rounds."""
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]

    def rounds(n: int) -> None:
        a, b, c, d = v
        for _ in range(n):
            a = (a + b) & MASK
            c = (c + d) & MASK
            b = ((b << 13) | (b >> 51)) & MASK ^ a
            d = ((d << 16) | (d >> 48)) & MASK ^ c
            a = ((a << 32) | (a >> 32)) & MASK
            c = (c + b) & MASK
            a = (a + d) & MASK
            b = ((b << 17) | (b >> 47)) & MASK ^ c
            d = ((d << 21) | (d >> 43)) & MASK ^ a
            c = ((c << 32) | (c >> 32)) & MASK
        v[:] = a, b, c, d

    whole = len(data) - len(data) % 8
    for i in range(0, whole, 8):
        m = int.from_bytes(data[i : i + 8], "little")
        v[3] ^= m
        rounds(2)
        v[0] ^= m
    last = int.from_bytes(data[whole:], "little") | (len(data) & 0xFF) << 56
    v[3] ^= last
    rounds(2)
    v[0] ^= last
    v[2] ^= 0xFF
    rounds(4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def text_bytes(s: str) -> bytes:
    """A string as it is fed to the hash: its bytes and an end mark."""
    return s.encode() + b"\xff"


def tokens_bytes(tokens: list[str]) -> bytes:
    """A token window as it is fed to the hash: its length, then each token."""
    return len(tokens).to_bytes(8, "little") + b"".join(map(text_bytes, tokens))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def siphash24_many(items: list[bytes], k0: int, k1: int) -> np.ndarray:
    """``siphash24`` of many strings: those of one number of blocks go through the rounds together."""
    out, blocks = np.empty(len(items), np.uint64), np.fromiter((len(x) // 8 for x in items), np.int64, len(items))
    order = np.argsort(blocks, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1) if len(items) else []:
        width = 8 * int(blocks[at[0]]) + 7
        flat = b"".join(items[i].ljust(width, b"\0") + bytes([len(items[i]) & 0xFF]) for i in at)
        m = np.frombuffer(flat, "<u8").reshape(len(at), -1)
        start = (k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573)
        a, b, c, d = (np.full(len(at), x, np.uint64) for x in start)
        for step in [*m.T, None]:
            if step is None:
                c = c ^ np.uint64(0xFF)
            else:
                d = d ^ step
            for _ in range(4 if step is None else 2):
                a, c = a + b, c + d
                b, d = _turned(b, 13) ^ a, _turned(d, 16) ^ c
                a = _turned(a, 32)
                c, a = c + b, a + d
                b, d = _turned(b, 17) ^ c, _turned(d, 21) ^ a
                c = _turned(c, 32)
            if step is not None:
                a = a ^ step
        out[at] = a ^ b ^ c ^ d
    return out


def sip_pairs(items: list[bytes], seeds: tuple[tuple[int, int], tuple[int, int]] = ((0, 0), (1, 1))) -> tuple[np.ndarray, np.ndarray]:
    a, b = (siphash24_many(items, *s) for s in seeds)
    return a, b


def sip_hashes(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """(k, n) wrapping 64-bit hashes."""
    i = np.arange(k, dtype=np.uint64)[:, None]
    c = np.array([cubic(x) for x in range(k)], np.uint64)[:, None]
    return a[None] + i * b[None] + c


@F.pandas_udf(T.ArrayType(T.LongType()))
def sip_positions(keys: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Columns key, k, bits: the first k hashes modulo ``bits`` under seeds (0, 0) and (1, 1)."""
    for key, k, bits in keys:
        a, b = sip_pairs([text_bytes(x) if x is not None else b"" for x in key])
        every = sip_hashes(a, b, int(k.max()) if len(k) else 0) % bits.to_numpy(np.uint64)[None]
        yield pd.Series([None if x is None else every[:n, i].astype(np.int64) for i, (x, n) in enumerate(zip(key, k, strict=True))])
