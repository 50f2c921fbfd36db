"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps a fixed number of open windows.  Whole windows are cut off a long document
first; the rest goes into the open window that it fits best.  When none fits and no further window
may be opened, the fullest one is filled up with the document's next ids and emitted, and what is left
of the document is placed again.  The windows still open at the end are merged, a bounded
number of partitions to a task, by filling one window from the next; a window that stays short
is padded.

Defined results: a null or empty text is the single end id; repeated rows are packed like
others; an empty table gives no pieces; only the key and text columns are read.
"""

from __future__ import annotations

import functools
import os
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tune

WINDOW = 2048
OPEN_WINDOWS = 16
#: Partitions whose leftover windows one merging task takes.
MERGE_PARTITIONS = 16
END_ID = 1
#: Chunks in one of the two generations that a worker remembers.
CACHE_WORDS = 500_000
LONG_WORD = 64
OUT = "doc_id {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean, part int"


class WordTokenizer:
    """Whole-text ids from a tokenizer that drops white space: chunks between spaces are tokenised once.

    Normalisation and splitting of this tokenizer never look across a space or line feed, so the ids of a
    text are its chunks' ids in order.  Special-token strings hold no space, so they stay in one chunk.
    Remembered chunks live in two generations of bounded size: what is not met again while the younger one fills is forgotten.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        chunks = [t.replace("\n", " ").split(" ") for t in texts]
        young, old = self.young, self.old
        fresh = []
        for w in {w for c in chunks for w in c}:
            if w not in young:
                if (known := old.get(w)) is None:
                    fresh.append(w)
                else:
                    young[w] = known
        for i in range(0, len(fresh), 10_000):
            part = fresh[i : i + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                young[w] = array("I", e.ids).tobytes() if little else b"".join([x.to_bytes(4, "little") for x in e.ids])
        out = [b"".join(map(young.__getitem__, c)) for c in chunks]
        for w in fresh:
            if len(w) > LONG_WORD:
                del young[w]
        if len(young) > CACHE_WORDS:
            self.old, self.young = young, {}
        return out


little = sys.byteorder == "little" and array("I").itemsize == 4


@functools.lru_cache(2)
def word_tokenizer(tokenizer_json: str) -> WordTokenizer:
    """One per Python worker, kept from task to task."""
    return WordTokenizer(tokenizer_json)


class Packer:
    """Open windows of one partition; ``emit`` gets (window number, pieces) of each closed window."""

    def __init__(self, first: int, size: int = WINDOW, most: int = OPEN_WINDOWS):
        self.next, self.size, self.most = first, size, most
        self.open: list[tuple[int, list]] = []  # (ids held, pieces)
        self.closed: list[tuple[int, list]] = []

    def _close(self, pieces: list) -> None:
        self.closed.append((self.next, pieces))
        self.next += 1

    def add(self, doc, ids: bytes, total: int, start: int = 0) -> None:
        """Pieces are (doc, start, ids, doc_tokens)."""
        n, at = len(ids) // 4, 0
        while n - at >= self.size:
            self._close([(doc, start + at, ids[4 * at : 4 * (at + self.size)], total)])
            at += self.size
        while at < n:
            left = n - at
            best = max((i for i, (held, _) in enumerate(self.open) if self.size - held >= left), key=lambda i: self.open[i][0], default=None)
            if best is None and len(self.open) < self.most:
                self.open.append((left, [(doc, start + at, ids[4 * at :], total)]))
                return
            if best is None:
                best = max(range(len(self.open)), key=lambda i: self.open[i][0])
            held, pieces = self.open[best]
            take = min(left, self.size - held)
            pieces.append((doc, start + at, ids[4 * at : 4 * (at + take)], total))
            at += take
            if held + take == self.size:
                self._close(pieces)
                self.open.pop(best)
            else:
                self.open[best] = (held + take, pieces)

    def add_cut(self, doc, ids: bytes, total: int, start: int) -> None:
        """Merging: fill the one open window to its end, cutting the piece where it ends."""
        at, n = 0, len(ids) // 4
        while at < n:
            held, pieces = self.open.pop() if self.open else (0, [])
            take = min(n - at, self.size - held)
            pieces.append((doc, start + at, ids[4 * at : 4 * (at + take)], total))
            at += take
            if held + take == self.size:
                self._close(pieces)
            else:
                self.open.append((held + take, pieces))


def rows_of(windows: list[tuple[int, list]], kind: pa.DataType, is_open: bool, part: int) -> pa.RecordBatch:
    flat = [(d, s, i, t, w) for w, pieces in windows for d, s, i, t in pieces]
    offsets = []
    for _, pieces in windows:
        at = 0
        for p in pieces:
            offsets.append(at)
            at += len(p[2]) // 4
    i64, col = pa.int64(), list(zip(*flat, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays(
        [
            pa.array(col[0], kind), pa.array(col[1], i64), pa.array(col[2], pa.binary()), pa.array(col[3], i64), pa.array(col[4], i64),
            pa.array(offsets, i64), pa.array([is_open] * len(flat), pa.bool_()), pa.array([part] * len(flat), pa.int32()),
        ],
        names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "open", "part"],
    )


def pack_documents(docs: DataFrame, tokenizer_json: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    The tokenizer's definition travels with the tasks, so executors need no file.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "packing")
    src = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    schema = OUT.format(kind=dict(src.dtypes)["doc_id"])
    definition = spark.sparkContext.broadcast(tokenizer_json)  # the file's size, whatever the input
    end = END_ID.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, words, kind = Packer(part << 32, window, open_windows), None, None
        for b in batches:
            kind = b.schema.field(0).type
            words = words or word_tokenizer(definition.value)
            texts, ids = ["" if t is None else t for t in b.column(1).to_pylist()], b.column(0).to_pylist()
            for i in range(0, len(texts), 200):
                for doc, own in zip(ids[i : i + 200], words.encode(texts[i : i + 200]), strict=True):
                    packer.add(doc, own + end, len(own) // 4 + 1)
                if packer.closed:
                    yield rows_of(packer.closed, kind, False, part)
                    packer.closed = []
        if packer.open:
            yield rows_of([(packer.next + i, pieces) for i, (_, pieces) in enumerate(packer.open)], kind, True, part)

    packed = scratch.keep(src.mapInArrow(first, schema))
    left = packed.where("open").withColumn("part", F.floor(F.col("part") / MERGE_PARTITIONS).cast("int"))

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        group = rows.column("part")[0].as_py()
        packer = Packer((1 << 62) + (group << 32), window, 1)
        for doc, start, ids, total in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            packer.add_cut(doc, ids, total, start)
        kind = rows.schema.field("doc_id").type
        done = packer.closed + ([(packer.next, packer.open[0][1])] if packer.open else [])
        return pa.Table.from_batches([rows_of(done, kind, False, group)])

    merged = left.groupBy("part").applyInArrow(merge, schema)
    return packed.where(~F.col("open")).unionByName(merged).drop("open", "part")


def padded_length(held: int, window: int = WINDOW) -> int:
    """What a sequence of ``held`` ids is padded to: the window, except at a power of two."""
    return held if held & (held - 1) == 0 else window
