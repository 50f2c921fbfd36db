from __future__ import annotations

import random
import re
from collections import Counter

from sketchloom.llm import rules
from sketchloom.llm.queries import op5_quality_rules, oracle_sql

from ..conftest import rows_of
from .helpers import SMALL, extra, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def test_measures(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op5_quality_rules(spark, SMALL).collect():
        n, chars, symbols, dup, rep = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n) and (not r.base_failed or not r.kept)


def test_measures_on_random_and_odd_texts():
    r = random.Random(0)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(200)]
    texts += ["a\x0bb\x0cc\rd e f", " x ", "a b c d e " * 3 + "z", "\n a\n a\nA\n\n\n", " ".join(map(str, range(7_000))) + " 1 2 3 4 5 6"]
    for t in [*texts, None, ""]:
        assert rules.measure(t) == brute(t), t[:50]


def test_hosts_are_shrunk_and_rejected(spark):
    good, bad = "one two three four five six seven eight nine ten " + " ".join(map(str, range(30))), "x y z"
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, bad, "poor") for i in range(95)] + [(1200 + i, good, "poor") for i in range(5)]
    rows += [(2000, bad, "tiny"), (2001, good, "tiny"), (3000, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in rules.verdicts(docs).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[i] for i in range(1000, 1205) if i in kept)
    assert kept[2001] and kept[3000] and not kept[2000]
    left = rules.apply_rules(extra(docs))
    assert left.columns == extra(docs).columns and {r.doc_id for r in left.collect()} == {i for i, k in kept.items() if k}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = rules.verdicts(extra(docs))
    assert out.count() == docs.count() and rules.verdicts(docs.limit(0)).count() == 0
    assert rules.apply_rules(docs).count() == out.where("kept").count()


def test_against_sql(spark, duck):
    df = op5_quality_rules(spark, SMALL)
    found = duck.execute(oracle_sql()["op5_quality_rules"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in found.description], found.fetchall())


def test_null_and_odd_hosts_are_apart(spark):
    """A null host and hosts named like stand-ins for it: rows in are rows out, and each is judged alone."""
    good, bad = "one two three four five six seven eight nine ten " + " ".join(map(str, range(30))), "x y z"
    for poor in ([None, "\x00", ""], ["\x00"], [""], [None], ["_host"]):
        rows, i = [], 0
        for host in (None, "\x00", "", "fine", "_host", "null"):
            for _ in range(60):
                rows.append((i, bad if host in poor else good, host))
                i += 1
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        out = rules.verdicts(docs).collect()
        assert sorted(r.doc_id for r in out) == list(range(i))
        expected = {d for d, _, host in rows if host not in poor}
        assert {r.doc_id for r in out if r.kept} == expected
        clash = docs.withColumns({"_host": docs.source, "_host_none": docs.doc_id, "_HOST__none": docs.text})
        left = rules.apply_rules(clash)
        assert left.columns == clash.columns and sorted(r.doc_id for r in left.collect()) == sorted(expected)


def test_rejected_hosts_beyond_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" if i % 2 else " ".join(map(str, range(20))), f"h{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    few = {r.doc_id: r.kept for r in rules.verdicts(docs).collect()}
    monkeypatch.setattr("sketchloom.llm.common.BROADCAST_BYTES", 0)
    out = rules.verdicts(docs)
    assert {r.doc_id: r.kept for r in out.collect()} == few and set(few.values()) == {True, False}
