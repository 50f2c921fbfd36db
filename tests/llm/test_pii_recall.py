"""What the tagger finds, form by form, in sentences that its generator never makes."""

from __future__ import annotations

import random

import pytest
from sketchloom.llm import pii

NAMES = "robert anna kurt maria.lopez j.smith42 sofia peter_w lee hans-peter d.okafor".split()
HOSTS = "post mailbox chemistry uni-bonn gmail host7 acme river northwind x".split()
ENDS = "org com de edu net io fr uk".split()
SENTENCES = [
    "please write to {} when you can", "Contact: {}, room 4", "you may reach me under {} or by letter", "The address of the office is {}. It opens at nine.",
    "send the forms back ({}) before Monday", "He said his mail was {} and left the building at noon", "Questions? {}", "{} is where the list of names must go",
]


def card(r):
    body = "4" + "".join(r.choice("0123456789") for _ in range(14))
    full = next(body + c for c in "0123456789" if pii.luhn(body + c))
    return ".".join(full[i : i + 4] for i in range(0, 16, 4))


FORMS = {
    "x at h dot e": lambda r, n, h, e: f"{n} at {h} dot {e}",
    "x at h.e": lambda r, n, h, e: f"{n} at {h}.{e}",
    "x AT h.e": lambda r, n, h, e: f"{n} AT {h}.{e}",
    "x [at] h [dot] e": lambda r, n, h, e: f"{n} [at] {h} [dot] {e}",
    "x(at)h(dot)e": lambda r, n, h, e: f"{n}(at){h}(dot){e}",
    "x @ h.e": lambda r, n, h, e: f"{n} @ {h}.{e}",
    "(ddd) ddd-dddd": lambda r, n, h, e: f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}",
    "ddd-ddd-dddd": lambda r, n, h, e: f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}",
    "ddd.ddd.dddd": lambda r, n, h, e: f"{r.randint(200, 999)}.{r.randint(200, 999)}.{r.randint(1000, 9999)}",
    "card with dots": lambda r, n, h, e: card(r),
    "eight groups": lambda r, n, h, e: ":".join(f"{r.randint(0, 65535):x}" for _ in range(8)),
    "groups left out": lambda r, n, h, e: f"2001:db8::{r.randint(1, 65535):x}:{r.randint(1, 65535):x}",
}


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


@pytest.mark.parametrize("form", FORMS)
def test_recall_of_each_form(tagger, form):
    r = random.Random(77)
    spans = [FORMS[form](r, r.choice(NAMES), r.choice(HOSTS), r.choice(ENDS)) for _ in range(100)]
    texts = [r.choice(SENTENCES).format(s) for s in spans]
    found = [[t[a:b] for _, a, b in every] for t, (_, every) in zip(texts, pii.scan(texts, tagger), strict=True)]
    hits, others = sum(s in f for s, f in zip(spans, found, strict=True)), sum(x != s for s, f in zip(spans, found, strict=True) for x in f)
    print(form, "found", hits, "others", others)
    assert hits >= 90 and others <= 3


def test_named_examples(tagger):
    for s in ("robert at post.org", "dead:beef:cafe::face", "ann at mail dot com"):
        for sentence in SENTENCES[:3]:
            t = sentence.format(s)
            assert s in [t[a:b] for _, a, b in pii.scan([t], tagger)[0][1]], t


def test_long_local_part(tagger):
    """A span is never cut in the middle of a word: it is found whole or not at all."""
    name = "jonathan.montgomery.of.the.old.mill.by.the.river.and.sons.ltd"
    for at, dot in ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)")):
        t = f"please write to {name}{at}mail{dot}com today"
        for _, a, b in pii.scan([t], tagger)[0][1]:
            assert (a == 0 or t[a - 1] in " (") and t[a:b] == f"{name}{at}mail{dot}com", t[a:b]


def test_plain_prose_has_none(tagger):
    calm = [
        "we met at the station. Then we left", "look at this. That dot is small", "He arrived at noon.Then it rained", "a dot com company at large", "the ratio 3:2 at 14:30:05", "see chapter 4.2.1 at page 77",
        "built at 2024-01-12 12:30:01 for $300.25", "ISBN 978-3-16-148410-0", "order 555 1234", "sha 0123456789abcdef0123456789abcdef01234567", "std::vector<int> at::tensor", "a::b::c", "ratio of 1.2.3",
    ]
    assert [t for t, (_, every) in zip(calm, pii.scan(calm, tagger), strict=True) if every] == []
