"""Shared plumbing: table access, shared-folder tables, checked joins, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import trim, tune  # noqa: F401  (operators take it from here)

#: Bytes of a side up to which it may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Words that a Python worker remembers for one operator; it may run several, and others wait beside it.
KNOWN_WORDS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session or the cluster names it.

    Where the setting is missing a local folder is made and remembered, but only if driver and executors are one
    process (tests, a single machine); on a cluster the missing setting is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("sketchloom.shared.dir", None)
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sketchloom-")
        spark.conf.set("sketchloom.shared.dir", found)
    return found.rstrip("/")


#: Folders of this process's scratch tables, oldest first.
_roots: list[str] = []


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    They live until ``release`` or, since a lazy result may still read them, until the driver's JVM ends in good order
    (the file system then deletes them); a driver that is killed leaves them to whoever cleans the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.option("compression", codec).parquet(path)
        if self.made == 1:
            _roots.append(self.root)
            at, system = _path(self.spark, self.root)
            system.deleteOnExit(at)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that no later plan reads."""
        for df in frames:
            at, system = _path(self.spark, df._scratch_path)
            system.delete(at, True)


def scratch_mark() -> int:
    """A point in time for ``release``."""
    return len(_roots)


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Remove the scratch tables made between two marks; results that still read them are lost."""
    for root in _roots[since:until]:
        at, system = _path(spark, root)
        system.delete(at, True)
    del _roots[since:until]


def bytes_of(df: DataFrame) -> int:
    """Bytes that the rows of a small table take, roughly: text and binary by their length, other columns eight each."""
    wide = [F.coalesce(F.octet_length(df[c]), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes]
    return df.select(sum(wide, F.lit(16)).cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str, limit: int | None = None) -> DataFrame:
    """Join ``small``, a kept table: broadcast if its measured bytes allow it, a shuffle join beyond."""
    fits = bytes_of(small) <= (BROADCAST_BYTES if limit is None else limit)
    return big.join(F.broadcast(small) if fits else small.hint("merge"), on, how)


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, known: dict | None = None) -> DataFrame:
    """Map Arrow batches one to one; ``known``, what ``fn`` remembers, is forgotten and freed memory given back once a task's batches are through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out
        if known is not None:
            known.clear()
        trim()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text", empty: str | None = "") -> list:
    """The texts of a batch; a null becomes ``empty``."""
    return [empty if t is None else t for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def fresh_name(df: DataFrame, name: str, *ends: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, nor it with one of ``ends`` (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while any(name + e in taken for e in ("", *ends)):
        name += "_"
    return name
