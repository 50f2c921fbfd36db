from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from sketchloom.llm import bpe
from sketchloom.llm.queries import op10_byte_bpe

from .helpers import ODD_TEXTS, SMALL, extra, odd_documents

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return struct.pack(f"<{len(ids)}I", *ids)


def test_query_against_the_library(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op10_byte_bpe(spark, SMALL).collect():
        ids = ids_of(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


@pytest.mark.parametrize("encode", [bpe.encode_documents, bpe.encode_documents_natively])
def test_odd_texts_round_trip(spark, encode):
    more = ["  two  spaces \n\n tail  ", "a b　c  \x85 d", "don't I'LL we've", "日本語テキスト ١٢٣ ½²", "\ttab\x1c\x1d\x1fz", "é​﻿", "<|endoftext|>", "aaaaaaaaaaaaaaaa" * 9]
    docs = odd_documents(spark, [*ODD_TEXTS, *more])
    got = encode(extra(docs), RANKS, public_tokenizers.PATTERN).collect()
    key = lambda d, i: (d is None, d or 0, i)
    assert sorted((key(r.doc_id, bytes(r.ids)) for r in got)) == sorted(key(r.doc_id, ids_of(r.text)) for r in docs.collect())
    assert sorted(bytes(r.decoded) for r in got) == sorted((r.text or "").encode() for r in docs.collect())
    assert encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_short_and_long_folds_agree():
    r = random.Random(1)
    encoder = bpe.WordEncoder(RANKS, public_tokenizers.PATTERN)
    for _ in range(300):
        word = "".join(r.choice("abcdeéß stre") for _ in range(r.randint(1, 60))).encode()
        assert bpe.fold_short(word, RANKS) == bpe.fold_long(word, RANKS)
    text = "".join(r.choice("abcdeéß 12\n#%'stre ") for _ in range(4_000))
    assert encoder.encode(text) == ids_of(text) and encoder.decode(ids_of(text)) == text.encode()
    encoder.old, encoder.young = encoder.young, {}
    assert encoder.encode(text) == ids_of(text)
