"""Gated decoding finds what decoding every window finds."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sketchloom.llm import pii

from .helpers import ODD_TEXTS

FORMS = ["anna at mailbox.org", "kurt AT host.de", "eva At mail-box.example.com", "dead:beef::cafe:babe", "fe::ab:cdef", "abcd:ef:ab:cd:ef:ab:cd:ef", "::ffff:abcd", "::%abcdefgh", "a [at] b [dot] de", "x.y(at)post(dot)net", "anna at host dot com"]


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def prose(n, seed=4):
    """Words without a digit or sign, with forms in between at every alignment."""
    r, made = random.Random(seed), pii.Samples(7)
    for i in range(n):
        words = [made.word() for _ in range(r.randint(1, 60))]
        words.insert(r.randrange(len(words) + 1), FORMS[i % len(FORMS)])
        yield " ".join(words)


def test_every_plausible_form_meets_a_trigger():
    """Each window that holds the form whole is decoded, wherever the form lies; also forms that the samples make."""
    samples = pii.Samples(3)
    forms = FORMS + [s for k, s in (samples.span() for _ in range(3_000)) if pii.plausible(k, s)]
    assert all(pii.plausible(0, f) or pii.plausible(1, f) for f in FORMS if len(f) > 9)
    for i, f in enumerate(forms):
        text = "x " * (i % 97) + f + " y" * 90
        a = 2 * (i % 97)
        got = set(pii.windows_of(text))
        assert all(w in got for w in pii.windows_of(text, gated=False) if w[0] <= a and a + len(f) <= w[1]), f


def test_forms_without_a_digit_are_found(tagger):
    assert pii.windows_of("write to anna at mailbox.org please")
    text = "the host dead:beef::cafe:babe said no"
    assert pii.scan([text], tagger)[0] == ([], [(1, 9, 29)])
    some = [t for t in prose(330) if "kurt AT host.de" in t]
    assert sum("kurt AT host.de" in [t[a:b] for _, a, b in every] for t, (_, every) in zip(some, pii.scan(some, tagger), strict=True)) > 20


def test_gated_and_ungated_scans_agree(spark, tagger):
    """On every whole text of a table, and on forms that the table does not hold."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += [t or "" for t in ODD_TEXTS] + list(prose(300))
    gated, every = pii.scan(texts, tagger), pii.scan(texts, tagger, gated=False)
    assert gated == every
    assert sum(len(a) - len(b) for b, a in gated) > 50
    assert sum(len(pii.windows_of(t)) for t in texts) < sum(len(pii.windows_of(t, gated=False)) for t in texts) / 2


class Marks:
    """In a tagger's place: brackets begin and end a span of the first kind; a window without the beginning sees a span from its start on."""

    def decode(self, x):
        at, end = pii.encode("~")[0], pii.encode("^")[0]
        tags = np.zeros(x.shape, np.int8)
        for r, row in enumerate(x):
            begins, ends = np.flatnonzero(row == at), np.flatnonzero(row == end)
            if len(ends) and (not len(begins) or ends[0] < begins[0]):
                tags[r, : ends[0]], tags[r, 0] = 2, 1
            for b in begins:
                e = next((e for e in ends if e > b), len(row))
                if b + 1 < e:
                    tags[r, b + 1 : e], tags[r, b + 1] = 2, 1
        return tags, np.ones(x.shape)


@pytest.mark.parametrize("length", [20, 47, 48, 61, 95, 96, 150, 700])
def test_spans_are_whole_at_every_alignment(length):
    """Digits before and behind keep every window alive."""
    span = "a" * (length - 10) + " [at] b.de"
    for shift in range(100):
        text = "7" * shift + " 1 2 3 4 5 6 7 8 9" * 4 + "~" + span + "^" + " 1 2 3 4 5 6 7 8 9" * 8
        a = text.index("~") + 1
        assert pii.tagged_spans([text], Marks()) == [[(0, a, a + length)]], shift


def test_long_spelled_addresses(tagger):
    """As often found at one place of the grid as at another."""
    long, hits = "jonathan.montgomery [at] chemistry [dot] university [dot] edu", []
    for shift in range(0, 96, 3):
        text = ("12 " * 40)[:shift] + "tel 4 or " + long + " and 12 more " * 12
        hits.append(long in [text[a:b] for _, a, b in pii.scan([text], tagger)[0][1]])
    print("found", sum(hits), "of", len(hits))
    assert sum(hits) >= 0.9 * len(hits)


def test_growing_ends(tagger):
    """Long runs that the tagger may take for one span grow to the text and no further."""
    for t in ["0" * 5_000, "4111-" * 2_000, "a@b." * 1_000, "dead:" * 2_000]:
        pii.scan([t], tagger)
