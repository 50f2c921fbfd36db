"""The training-corpus pipeline: five stages, each over all that the one before kept.

Defined results: all stages but the last return the columns of documents, whatever further columns there are; a null or wordless text is
rejected by the classifier (unless no labels of both kinds exist) and by the rules at the latest; rows that repeat an id and text share one fate up to
near-dedup, which leaves one row of the smallest id of each component; a row with a null id is judged like others and is never a near copy;
ties are broken by smaller ids; an empty table gives an empty result.  Each stage's docstring has its own cases.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import neardup, packing, quality, queries, rules, secrets
from sketchloom.llm.common import Scratch, release, scratch_mark, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; its labels come from the tables."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes."""
    return rules.apply_rules(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: five-word shingles, similarity from 0.8 on."""
    return neardup.keep_one(docs, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed windows, with their token ids."""
    definition = Path(queries.tokenizer_file("word_bpe_49k.json")).read_text()
    pieces = packing.pack_documents(docs, definition)
    return pieces.withColumn("length", F.floor(F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_rules),
    ("minhash_neardup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: The classifier's model and the tokenizer's ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again.

    What a stage needed for itself, and the result before it, are removed once its own result is written.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        began = scratch_mark()
        made = stage(spark, docs, sf_dir)
        ended = scratch_mark()
        docs = scratch.keep(made)
        release(spark, began, ended)
        if last is not None:
            scratch.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
