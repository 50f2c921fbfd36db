from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from sketchloom.llm import packing, quality, rules, secrets
from sketchloom.llm.common import table

from .helpers import SMALL, extra, odd_documents
from .test_neardup import brute as near
from .test_packing import expected
from .test_rules import brute as measure


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "minhash_neardup", "secret_scan", "packing"]


def test_pipeline_against_plain_python(spark):
    """Every stage on what the one before kept, and the packed ids of what is left."""
    docs = table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality.classify(docs, table(spark, SMALL, "labels")).where("kept").collect()}
    one = {r.doc_id: r.text for r in corpus_pipeline.classify_quality(spark, docs, SMALL).collect()}
    assert set(one) == kept
    limits = rules.RuleLimits()
    two = {d: t for d, t in one.items() if measure(t)[0] >= limits.least_words and 100 * measure(t)[4] <= limits.repeat_percent * measure(t)[0]}
    three = {d: two[d] for d, _, _, k in near(list(two.items()), 80) if k}
    four = {d: secrets.mask(t, secrets.scan(t)[1]) for d, t in three.items()}
    ids = dict(zip(four, expected(list(four.values())), strict=True))
    got: dict = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    packed = {d: b"".join(i for _, i in sorted(p)) for d, p in got.items()}
    assert packed == {d: b"".join(i.to_bytes(4, "little") for i in x) for d, x in ids.items()}
    assert texts.keys() >= packed.keys() and packing.WINDOW == 2048


def test_stages_keep_the_columns(spark):
    docs = table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def odd_folder(spark, path):
    """Tables with odd rows, repeated rows, ties and clashing columns beside real documents."""
    odd = extra(odd_documents(spark)).drop("n")
    real = extra(table(spark, SMALL, "documents").select("doc_id", "text", "source").withColumn("host", F.lit(None).cast("string")))
    real = real.select(*[c for c in odd.columns]).where("doc_id >= 20")
    twice = real.where("doc_id < 60")
    odd.unionByName(real).unionByName(twice).unionByName(twice.withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{path}/documents.parquet")
    table(spark, SMALL, "labels").write.parquet(f"{path}/labels.parquet")
    return path


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls, repeats, ties and clashing columns: no crash, columns stay, and every stage's rows come from the one before."""
    d = odd_folder(spark, str(tmp_path / "t"))
    docs = table(spark, d, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, before, d)
        assert made.columns == columns
        rows, held = Counter(r.doc_id for r in made.select("doc_id").collect()), Counter(r.doc_id for r in before.select("doc_id").collect())
        assert not rows - held, name
        if name == "minhash_neardup":
            assert all(n == 1 for i, n in rows.items() if i is not None) and rows[None] == held[None] > 0
        before = made
    assert before.where("text IS NULL").count() == 0
    last = Counter(r.doc_id for r in before.select("doc_id").collect())
    pieces = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in pieces} == set(last)
    whole = Counter()
    for r in pieces:
        whole[r.doc_id] += len(r.ids) // 4
    assert all(whole[r.doc_id] == r.doc_tokens for r in pieces if r.doc_id is not None)
    # again, with the rows in another order
    shuffled = str(tmp_path / "s")
    docs.repartition(5, F.rand(3)).write.parquet(f"{shuffled}/documents.parquet")
    table(spark, d, "labels").write.parquet(f"{shuffled}/labels.parquet")
    again = corpus_pipeline.run(spark, shuffled).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in again if r.start == 0) == Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0)


def test_stage_tables_are_removed(spark, tmp_path):
    """A run leaves the last stage's input and what the result reads; the rest is gone."""
    from sketchloom.llm import common

    began = common.scratch_mark()
    out = corpus_pipeline.run(spark, SMALL)
    left = common._roots[began:]
    assert out.count() > 0 and [r.rsplit("/", 1)[1].split("-")[0] for r in left] == ["pipeline", "packing"]


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from sketchloom.llm import common

    conf = SimpleNamespace(get=lambda *a: None)
    for master, fails in (("yarn", True), ("local-cluster[3,2,1000]", True), ("local[8]", False), ("local", False)):
        fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None), sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
        if fails:
            with pytest.raises(ValueError):
                common.shared_dir(fake)
        else:
            assert common.shared_dir(fake).startswith("file://")
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda name, *a: "hdfs://x/y/" if name == "spark.checkpoint.dir" else None), sparkContext=SimpleNamespace(master="yarn", getConf=lambda: conf))
    assert common.shared_dir(named) == "hdfs://x/y"
