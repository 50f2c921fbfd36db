from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from sketchloom.llm import pii
from sketchloom.llm.queries import op8_personal_data
from sketchloom.llm.tagger import MOVE, START, TAGS, Tagger

from .helpers import SMALL, extra, odd_documents

PATTERNS = [
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def brute(text):
    return [(k, *m.span()) for k, (p, good) in enumerate(PATTERNS) for m in p.finditer(text) if good(m.group())]


def test_base_spans_on_hard_strings():
    texts = [
        "a@foo.com@bar.com @x.y a@b@c.de .@a.b a@b..c x@a.b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 9.1.2.3.x a1..2.3.4.5", "4111 1111 1111 1111 4111-1111-1111-1111-4 4111111111111111",
        "+1 (212) 555-0100 +49 30 123456 +1+2 +12) 3 ++44 20 7946 0958.", "@" * 50, "1" * 30, "", "0.0.0.0@h.c +1 1.1.1.1",
    ]
    for t in texts:
        assert pii.base_spans(t) == brute(t), t


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def test_gradients_are_the_losses_slopes():
    x, y = pii.Samples(1).batch(3)
    t = Tagger(hidden=4)
    _, grads = t.loss(x[:, :10], y[:, :10])
    for k, g in grads.items():
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        held, ends = t.p[k], []
        for e in (1e-2, -1e-2):
            t.p[k] = held.copy()
            t.p[k][i] += e
            ends.append(t.loss(x[:, :10], y[:, :10])[0])
        t.p[k] = held
        assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(g[i], rel=2e-2)


def test_decoding_is_the_best_path():
    t = Tagger(hidden=4, seed=9)
    x, _ = pii.Samples(2).batch(2)
    x = x[:, :3]
    tags, _ = t.decode(x)
    e, moves = t.emissions(x), t.p["T"] + MOVE
    for b in range(2):
        paths = {(i, j, k): START[i] + e[0, b, i] + moves[i, j] + e[1, b, j] + moves[j, k] + e[2, b, k] for i in range(TAGS) for j in range(TAGS) for k in range(TAGS)}
        assert tuple(tags[b]) == max(paths, key=paths.get)


def test_held_out_accuracy(tagger):
    x, y = pii.Samples(99).batch(400)
    tags, _ = tagger.decode(x)
    spans = lambda t: {s[:3] for s in pii.spans_in(t, np.ones(len(t)))}
    hit = wrong = missed = 0
    for a, b in zip(tags, y, strict=True):
        p, q = spans(a), spans(b)
        hit, wrong, missed = hit + len(p & q), wrong + len(p - q), missed + len(q - p)
    assert hit / (hit + wrong) >= 0.85 and hit / (hit + missed) >= 0.85


def test_added_spans(tagger):
    for text, span in [("so call (212) 555-0199 about the rest", "(212) 555-0199"), ("the host 2001:db8::1f2e:77ab said no", "2001:db8::1f2e:77ab"), ("paid with 4111.1111.1111.1111 today", "4111.1111.1111.1111")]:
        base, every = pii.scan([text], tagger)[0]
        assert not base and [text[a:b] for _, a, b in every] == [span]
    calm = "on 2024-01-12 at 12:30:01 version 1.2.3 cost $300.25 and token = 0123456789abcdef01234567 look at this. That dot is small"
    assert pii.scan([calm], tagger)[0] == ([], [])


def test_reconciling_and_windows():
    assert pii.reconcile([(0, 0, 5, 3.0), (1, 4, 9, 5.0), (2, 9, 12, 1.0), (2, 9, 12, 2.0), (3, 20, 21, -1.0)]) == [(1, 4, 9), (2, 9, 12)]
    text = "x" * 300 + "7" + "y" * 300 + "8" * 200
    w = pii.windows_of(text)
    assert all(any(a <= i < b for a, b, _, _ in w) for i, c in enumerate(text) if c in "78") and all(b - a <= pii.WINDOW for a, b, _, _ in w)
    long = "call " + "(212) 555-0199 and " * 40
    inner = pii.windows_of(long)
    assert len(inner) > 5


def test_query(spark, tagger):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op8_personal_data(spark, SMALL).collect():
        base = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, _, _ in base) for i in range(4))
        joined = pii.join_spans(sorted(base))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_odd_rows(spark, tagger):
    docs = odd_documents(spark)
    assert pii.find_personal_data(extra(docs), tagger).count() == docs.count()
    assert pii.find_personal_data(docs.limit(0), tagger).count() == 0
