from __future__ import annotations

import zlib
from collections import defaultdict
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

from sketchloom.llm import packing
from sketchloom.llm.queries import op3_packing

from .helpers import SMALL, extra, odd_documents

FILE = public_tokenizers.path("word_bpe_49k.json")
DEFINITION = Path(FILE).read_text()


def expected(texts):
    t = Tokenizer.from_file(FILE)
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def le(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_chunks_give_the_ids_of_whole_texts():
    texts = ["Don't  stop\tnow\n\nAgain é é ́x", "a<|endoftext|>b <|startoftext|>", "　wide 1234 ### %%%", "x" * 300, "", "I'll 've 're İstanbul ǅ"]
    w = packing.WordTokenizer(DEFINITION)
    for _ in range(2):
        assert w.encode(texts) == [le(x[:-1]) for x in expected(texts)]
    w.young, w.old = {}, w.young
    assert w.encode(texts) == [le(x[:-1]) for x in expected(texts)]


def test_query_covers_every_id_once(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = dict(zip(docs, expected(list(docs.values())), strict=True))
    rows = op3_packing(spark, SMALL).collect()
    check(rows, ids, lambda r: (r.start, r.length, r.ids_crc32), lambda r, part: zlib.crc32(le(part)))


def check(rows, ids, cut, crc):
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(cut(r))
        windows[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id])
    for d, whole in ids.items():
        at = 0
        for start, length, c in sorted(pieces[d]):
            assert start == at and c == zlib.crc32(le(whole[start : start + length]))
            at += length
        assert at == len(whole)
    total = padded = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 2048
        total, padded = total + at, padded + packing.padded_length(at)
    assert padded - total <= 2048 * 2  # one short window for each merging task


def test_packer_bounds_its_open_windows():
    p = packing.Packer(0, 16, 3)
    for d, n in enumerate([5, 9, 40, 12, 7, 7, 7, 15, 1, 2, 3, 30]):
        p.add(d, le(range(n)), n)
        assert len(p.open) <= 3 and all(0 < held < 16 for held, _ in p.open)
    assert all(sum(len(x[2]) // 4 for x in pieces) == 16 for _, pieces in p.closed)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    pieces = packing.pack_documents(extra(docs), DEFINITION)
    total = sum(len(x) for x in expected([r.text for r in docs.collect()]))
    assert sum(len(r.ids) // 4 for r in pieces.collect()) == total
    assert packing.pack_documents(docs.limit(0), DEFINITION).count() == 0
    assert packing.padded_length(1024) == 1024 and packing.padded_length(1025) == 2048
