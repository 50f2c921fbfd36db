"""Byte-level BPE encoding and decoding: ranked merges folded over the bytes of distinct words.

Texts are split into words by the tokenizer's pattern; a word's bytes are merged, the leftmost pair of lowest rank
first, until no pair has a rank; decoding concatenates the pieces of the ids.  The method has two forms:

* ``encode_documents_natively``: Spark higher-order functions. Each distinct word of the corpus is encoded once by an ``aggregate``, with
  ranks looked up in a literal map (hashed into small maps, since a map literal is searched in order), and documents join
  the words' ids back. Bytes are held as one character each (the first 256 code points), so pieces are ordinary strings.
* ``encode_documents``: the same fold in Arrow batches, with distinct words remembered by each Python worker; nothing is shuffled.
  The native form exceeds the limits set for it (figures in the README), so this one serves the query.

Defined results: a null text counts as empty and has no ids; every row gives one row, repeated rows included; an
empty table gives an empty result; only the key and text columns are read.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tune

BUCKETS = 1 << 15
NONE = 1 << 30
#: Words in one of the two generations that a worker remembers; longer words are not.
CACHE_WORDS, LONG_WORD = 400_000, 64
#: White space as the tokenizer's own pattern engine has it.
SPACE = r"\t-\r\x20\x85\xA0  -     　"


def java_pattern(pattern: str) -> str:
    """The split pattern with white space spelled out, since Java's short forms cover ASCII only."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", rf"[{SPACE}]")


def parse_ranks(table: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(str.split, table.splitlines())}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path) as f:
        return parse_ranks(f.read())


class RankMap:
    """The ranks, and the pieces by id, as literals of constant size."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        pieces = spark.createDataFrame([(k.decode("latin-1"), v) for k, v in ranks.items()], "piece string, rank int")
        maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        for piece, rank, at in pieces.select("piece", "rank", self._at(F.col("piece"))).collect():
            maps[at - 1][piece] = rank
        self.ranks = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")
        by_id = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            by_id[rank] = piece.decode("latin-1")
        self.pieces = F.from_json(F.lit(json.dumps(by_id)), "array<string>")

    @staticmethod
    def _at(piece: Column) -> Column:
        return F.pmod(F.hash(piece), F.lit(BUCKETS)) + 1

    def rank(self, piece: Column) -> Column:
        return F.coalesce(F.try_element_at(F.element_at(self.ranks, self._at(piece)), piece), F.lit(NONE))


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_merges(word: Column, ranks: RankMap) -> Column:
    """array<string>: the pieces of a word (bytes as characters) after all merges.

    State: the pieces and the rank of each neighbouring pair. A step merges the leftmost pair of lowest rank and looks up
    the two pairs that it made; once no pair has a rank the state stays.
    """
    none = F.expr("cast(array() as array<int>)")
    rest = F.lit(1 << 20)

    def merged(s: Column, i: Column, new: Column) -> Column:
        p, r, n = s["p"], s["r"], F.size(s["p"])
        before = F.when(i > 1, F.array(ranks.rank(F.concat(F.element_at(p, F.greatest(i - 1, F.lit(1))), new)))).otherwise(none)
        after = F.when(i + 2 <= n, F.array(ranks.rank(F.concat(new, F.element_at(p, F.least(i + 2, n)))))).otherwise(none)
        return F.struct(
            F.concat(F.slice(p, F.lit(1), i - 1), F.array(new), F.slice(p, i + 2, rest)).alias("p"),
            F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), before, after, F.slice(r, i + 2, rest)).alias("r"),
        )

    def step(s: Column, _: Column) -> Column:
        def lowest(low: Column) -> Column:
            at = F.array_position(s["r"], low).cast("int")
            return F.when(low == NONE, s).otherwise(
                _let(at, lambda i: _let(F.concat(F.element_at(s["p"], i), F.element_at(s["p"], i + 1)), lambda new: merged(s, i, new)))
            )

        return _let(F.array_min(s["r"]), lowest)

    def fold(p: Column) -> Column:
        r = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: ranks.rank(F.concat(F.element_at(p, i), F.element_at(p, i + 1))))
        return F.aggregate(F.sequence(F.lit(2), F.size(p)), F.struct(p.alias("p"), r.alias("r")), step)["p"]

    single = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.call_function("substring", word, i, F.lit(1)))
    whole = (F.length(word) < 2) | (ranks.rank(word) < NONE)
    return F.when(whole, F.array(word)).otherwise(_let(single, fold))


def id_hex(i: Column) -> Column:
    """An id as little-endian unsigned 32 bits, in hexadecimal."""
    h = F.lpad(F.hex(i.cast("long")), 8, "0")
    part = lambda at: F.substring(h, at, 2)
    return F.concat(part(7), part(5), part(3), part(1))


def encode_words(words: DataFrame, ranks: RankMap) -> DataFrame:
    """Distinct words (column w) with ids (array<int>) and the same ids in hexadecimal."""
    bytes_as_text = F.decode(F.col("w").cast("binary"), "ISO-8859-1")
    return words.select("w", F.transform(fold_merges(bytes_as_text, ranks), ranks.rank).alias("ids")).withColumn("hex", F.array_join(F.transform("ids", id_hex), ""))


def decode_ids(ids: Column, ranks: RankMap) -> Column:
    """The bytes of ids, in hexadecimal: the pieces concatenated."""
    return F.array_join(F.transform(ids, lambda i: F.hex(F.encode(F.element_at(ranks.pieces, i + 1), "ISO-8859-1"))), "")


def encode_documents_natively(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary)."""
    spark = docs.sparkSession
    tune(spark)
    scratch, literal = Scratch(spark, "bpe"), RankMap(spark, ranks)
    words = F.regexp_extract_all(F.coalesce(docs[text], F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    # rows are numbered before words are exploded
    split = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("doc_id"), words.alias("words"))
    tokens = split.select("row", "doc_id", F.posexplode_outer("words").alias("pos", "w"))
    distinct = scratch.keep(tokens.where("w IS NOT NULL").select("w").distinct())
    coded = encode_words(distinct, literal)
    known = scratch.keep(coded.select("w", "hex", decode_ids(F.col("ids"), literal).alias("back")))
    placed = tokens.join(known, "w", "left").groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "hex", "back"))).alias("t"))
    side = lambda name: F.unhex(F.array_join(F.transform("t", lambda x: x[name]), ""))
    return placed.select("doc_id", side("hex").alias("ids"), side("back").alias("decoded"))


# The same method in Arrow batches.


def fold_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word: the leftmost pair of lowest rank is merged until no pair has a rank."""
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) < NONE:
        i = pairs.index(low)
        parts[i : i + 2] = [new := parts[i] + parts[i + 1]]
        pairs.pop(i)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + new, NONE)
        if i < len(pairs):
            pairs[i] = ranks.get(new + parts[i + 1], NONE)
    return [ranks[p] for p in parts]


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over neighbouring pieces, for words of any length."""
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        if i >= 0 and after[i] < n and (r := ranks.get(word[i : after[after[i]]])) is not None:
            heapq.heappush(heap, (r, i, after[after[i]]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue  # one of the two has changed since
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
        push(before[i])
        push(i)
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


class WordEncoder:
    """Encodes each distinct word once; remembered words live in two generations of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(java_pattern(pattern)).findall
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def word(self, w: str) -> bytes:
        raw = w.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else (fold_short if len(raw) <= 48 else fold_long)(raw, self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        young, old, long, words = self.young, self.old, {}, self.find(text)
        for w in words:
            if w not in young and w not in long:
                if (known := old.get(w)) is None:
                    known = self.word(w)
                (young if len(w) <= LONG_WORD else long)[w] = known
        out = b"".join([young[w] if w in young else long[w] for w in words]) if long else b"".join(map(young.__getitem__, words))
        if len(young) > CACHE_WORDS:
            self.old, self.young = young, {}
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def _encoder(table: str, pattern: str) -> WordEncoder:
    """One per Python worker, kept from task to task."""
    return WordEncoder(parse_ranks(table), pattern)


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary); no shuffle."""
    spark = docs.sparkSession
    tune(spark)
    table = "\n".join(f"{base64.b64encode(k).decode()} {v}" for k, v in ranks.items())
    shipped = spark.sparkContext.broadcast(table)  # the vocabulary's size, whatever the input
    src = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value, pattern)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for i in range(0, len(texts), 100):  # ids are longer than texts
                coded = [encoder.encode(t) if t else b"" for t in texts[i : i + 100]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, len(coded)), pa.array(coded, pa.binary()), pa.array(map(encoder.decode, coded), pa.binary())], names=["doc_id", "ids", "decoded"]
                )

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, ids binary, decoded binary")
