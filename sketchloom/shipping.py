"""The package travels to the executors by itself, so that a cluster needs no installation of it."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parents[1]
    path = f"{tempfile.mkdtemp(prefix='sketchloom-')}/sketchloom_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "sketchloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


#: Texts in one Arrow batch, and its bytes, about: some texts are long, and both sides of the pipe hold a batch.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def tune(spark: SparkSession) -> None:
    """Send the package, and keep Arrow batches small enough for tables of long texts.

    Their limits are read when a plan runs, so they are settings of the session: they are lowered where they are higher, never raised.
    """
    bytes_in = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes  # "1000", "4m"
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < bytes_in(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))
    ship(spark)


def trim() -> None:
    """Give freed memory back: a Python worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries other than GNU's have no such call
        ctypes.CDLL(None).malloc_trim(0)
