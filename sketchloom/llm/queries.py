"""The thin contract queries: each applies one operator to its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, neardup, packing, pii, quality, rules, secrets, shards, topk
from .common import table


def tokenizer_file(name: str) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    definition = Path(tokenizer or tokenizer_file("word_bpe_49k.json")).read_text()
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), definition)
    return pieces.select(
        "doc_id",
        "start",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").cast("long").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules.verdicts(table(spark, sf_dir, "documents")).select(*names)


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components_of(table(spark, sf_dir, "documents"), percent=85)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT stack(2, -7L, 0L, 'user', :said, -7L, 1L, 'assistant', :said) AS (conv_id, turn, role, text)", {"said": said})
    return chat.digest(chat.format_conversations(turns.unionByName(extra)))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    held = bpe.read_ranks(ranks or tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    pattern = importlib.import_module("public_tokenizers").PATTERN
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), held, pattern)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.SQL
