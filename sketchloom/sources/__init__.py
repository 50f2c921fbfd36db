"""Reading tables, and saving sketches as tables beside their specs."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.bloom import BloomSpec
from ..operators.cms import CmsSpec
from ..operators.fingerprint import CuckooSpec, QuotientSpec

SPECS = {c.__name__: c for c in (BloomSpec, CuckooSpec, QuotientSpec, CmsSpec)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save_sketch(sketch: DataFrame, spec, path: str) -> None:
    """The sketch and, in one row, its spec: both must match to merge or probe."""
    spark = sketch.sparkSession
    sketch.write.mode("overwrite").parquet(f"{path}/sketch")
    row = [(type(spec).__name__, json.dumps(dataclasses.asdict(spec)))]
    spark.createDataFrame(row, "kind string, spec string").write.mode("overwrite").parquet(f"{path}/spec")


def load_sketch(spark: SparkSession, path: str):
    """(sketch, spec)."""
    kind, text = spark.read.parquet(f"{path}/spec").first()
    return spark.read.parquet(f"{path}/sketch"), SPECS[kind](**json.loads(text))
