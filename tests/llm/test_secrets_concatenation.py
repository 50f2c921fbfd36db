"""Secrets in several literals."""

from __future__ import annotations

import time

from sketchloom.llm import secrets

from .test_secrets import lexed


def test_short_parts_are_scored_together():
    assert lexed('db_pwd = "aB3dE5f" + "hJ9kL1m"') == ["aB3dE5f", "hJ9kL1m"]
    assert lexed('A = "aB3dE5f"\nB = "hJ9kL1m"\nC = A + B\ndb_pwd = C') == ["aB3dE5f", "hJ9kL1m"]
    assert lexed('x = "aB3d"\ndb_pwd = x + "-" + x') == ["aB3d", "-"]
    text = 'db_pwd = "aB3dE5f" + "hJ9kL1m"'
    assert secrets.mask(text, secrets.scan(text)[1]) == 'db_pwd = "[SECRET]" + "[SECRET]"'


def test_what_is_last_assigned_counts():
    assert lexed('A = "title"\nA = "aB3dE5f"\ndb_pwd = A + "hJ9kL1m"\nA = "other"') == ["aB3dE5f", "hJ9kL1m"]


def test_other_concatenations_stay():
    assert lexed('title = "aB3dE5f" + "hJ9kL1m"') == [] and lexed('db_pwd = "aB" + "cD1"') == []
    assert lexed('db_pwd = "change" + "me" + "now1"') == [] and lexed('db_pwd = "aB3" + db_pwd') == [] and lexed('db_pwd = "the old " + "pass 12"') == []


def test_chains_that_double_end():
    began = time.time()
    secrets.lexed_spans("\n".join(f"k{i} = k{i + 1} + k{i + 1}" for i in range(300)) + '\nk300 = "aB3dE5f"\ndb_pwd = k0 + k1')
    secrets.lexed_spans("\n".join(f"secret{i} = secret{i + 1} + 'ab'" for i in range(200)))
    assert time.time() - began < 5
