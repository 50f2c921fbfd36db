"""Long tokens count whole."""

from __future__ import annotations

import zlib

import numpy as np

from sketchloom.llm import quality


def test_long_tokens_differ_beyond_their_beginning():
    f = quality.Featurizer()
    start = '{"a":1,"B":[2],'
    one, two = f.buckets(start * 3 + "x-y_z;" * 9), f.buckets(start * 3 + "Q7/k=!" * 9)
    assert len(one) > 20 and sorted(one) != sorted(two)
    assert len(f.buckets("https://a.example.org/b/c,https://d.example.org/e?f=1&g=2")) > 6


def test_pieces_count_like_tokens():
    f = quality.Featurizer()
    shape = "a1" * 9  # of 18 characters: a0a0a0a0a0a0 and a0a0a0
    assert list(f._shape(shape)) == [zlib.crc32(b"a0a0a0a0a0a0"), zlib.crc32(b"a0a0a0")]
    assert np.array_equal(f.buckets("go " + shape + " on"), f.buckets("go " + "a1" * 6 + " " + "b2" * 3 + " on"))
    again = f.buckets(shape + " " + shape)
    assert len(again) == 4 + 3 + 2 and len(set(again[:4])) == 4


def test_short_shapes_are_as_before():
    f = quality.Featurizer()
    assert f._shape("Hello") == zlib.crc32(b"Aaa") and f._shape("abcdefghijklmnopqrstuvwxyz,") == zlib.crc32(b"aa,")
