"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

Texts are linked from a similarity of ``percent`` on (85 unless told otherwise); every filter below follows from it (``Rule``).

A text's signature has chunks of ``CHUNK`` slots, each holding the low ``BITS`` bits of a minimum.  The signature
is split into chunks (``CHUNKS`` at 85); by the pigeonhole principle two signatures that differ in fewer than two
slots a chunk (at most ``GUARANTEED`` at 85) differ by at most one slot in some chunk.  Every chunk is indexed with its allowed
errors enumerated: once for each slot left out.

What is certain and what is only likely: all pairs of signatures at a distance up to ``GUARANTEED`` (23 of 72 slots at 85) share an index key.
Candidates are confirmed up to ``Rule.distance`` (31 at 85), which lies ``DEVIATIONS`` standard deviations above the mean distance of a pair at
the threshold; between the two a pair shares a key only if its differences leave some chunk with one at most.  Counting both, a pair exactly at
``percent`` is missed with a probability below 1e-7 (lower percentages have more chunks for that), a more similar one with less.
A link, once found, is always confirmed on full sets, so none is wrong.

Which links come from where: the Hamming join gives the links of every bucket's members to its smallest member.  Where a bucket's members
stay apart after those, the remaining links among them come from an exact prefix join on shingles (below), within which signatures only rule out.

Work is kept from growing with the square of a group:

* texts with equal shingle sets are one class, found by an aggregate, before any index;
* every bucket first links its members to its smallest member only; those links, confirmed on
  full shingle sets, make components, and a bucket that lies in one component is done;
* what is left (members of one bucket in different components, mostly texts that share a long passage) is split once more, exactly:
  similar sets share a shingle among their first ``n - ceil(percent n / 100) + 1`` in any fixed order, and the order
  puts passages last, so texts that share only a passage part; the groups of one such shingle are split by set size,
  since similar sets have similar sizes, and compared in blocks of bounded size. Ids and signatures travel to the blocks; a set follows only where its
  signature has found a partner, and only to its two largest groups (these settle the most pairs without emitting any; pairs that meet elsewhere are
  emitted and confirmed, unless the homes' links have made them one component by then). Every block is a task's unit, dealt by an explicit number of partitions.

Defined results: ASCII letters are lower-cased, words are runs without the six ASCII spaces; a text of fewer than
five words is one shingle; a null text, or one without words, has no set and links with nothing;
repeated rows (same id and text) each give a row, and the texts of an id that repeats count as
linked; a null id is never linked and is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KNOWN_WORDS, Scratch, join_checked, per_batch, tune
from .components import connected_components

CHUNK, BITS, WORDS, PERCENT = 6, 16, 5, 85
#: Probability that a pair at the threshold may miss the index, and standard deviations beyond which signatures are not confirmed.
MISS, DEVIATIONS = 5e-8, 6.67


@dataclass(frozen=True)
class Rule:
    """What follows from the least similarity that links, a percentage."""

    percent: int = PERCENT

    def __post_init__(self):
        if not 50 <= self.percent < 100:
            raise ValueError(f"percent must lie in 50..99, not {self.percent}")

    @property
    def chunks(self) -> int:
        p = self.percent / 100
        return math.ceil(math.log(MISS) / math.log(1 - p**CHUNK - CHUNK * (1 - p) * p ** (CHUNK - 1)))

    @property
    def slots(self) -> int:
        return self.chunks * CHUNK

    @property
    def distance(self) -> int:
        """Signatures further apart than this are not confirmed."""
        p = self.percent / 100
        return math.floor(self.slots * (1 - p) + DEVIATIONS * math.sqrt(self.slots * p * (1 - p)))

    def sizes_allow(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)


CHUNKS, SLOTS = Rule().chunks, Rule().slots
GUARANTEED = 2 * CHUNKS - 1
#: Members compared with one another in one block.
BLOCK = 512
#: Members that one task compares, about.
TASK_MEMBERS = 8_192
#: Bytes up to which the table of groups is broadcast.
LIVE_BYTES = 4 << 20
#: Frequent shingles that the prefix order puts last.
COMMON = 100_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _slots(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


class Shingler:
    """Distinct 5-word shingles as 64-bit hashes; word hashes are remembered."""

    def __init__(self, most: int = KNOWN_WORDS):
        self.known: dict[bytes, int] = {}
        self.most = most

    def shingles(self, text: str | None) -> np.ndarray:
        words = text.encode().translate(LOWER).split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.most:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = digest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        m = max(1, len(words) - WORDS + 1)
        out = np.full(m, min(len(words), WORDS), np.uint64)
        for k in range(min(WORDS, len(words))):
            out = (out ^ h[k : k + m]) * ODD
            out ^= out >> np.uint64(29)
        return np.unique(out)


def signature(shingles: np.ndarray, slots: int = SLOTS) -> bytes:
    """Low 16 bits of each slot's minimum, after a multiply-add on the 64-bit hash."""
    mul, add = _slots(slots)
    best = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):  # bounded memory on long texts
        values = mul[:, None] * shingles[i : i + 512]
        values += add[:, None]
        np.minimum(best, values.min(axis=1), out=best)
    best ^= best >> np.uint64(32)
    return (best & np.uint64(0xFFFF)).astype("<u2").tobytes()


def sketch(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, set_hash (two longs), sig, one row per row of ``docs``."""
    tune(docs.sparkSession)
    shingler, slots = Shingler(), rule.slots

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, one, two, sigs = [], [], [], []
        for t in b.column(1).to_pylist():
            s = shingler.shingles(t)
            n.append(len(s))
            h = xxhash.xxh3_128_intdigest(s.tobytes())
            one.append((h >> 64) - (1 << 63))
            two.append((h & (1 << 64) - 1) - (1 << 63))
            sigs.append(signature(s, slots) if len(s) else None)
        i64 = pa.int64()
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, i64), pa.array(one, i64), pa.array(two, i64), pa.array(sigs, pa.binary())], names=["doc_id", "n", "h1", "h2", "sig"])

    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return per_batch(src, run, "doc_id long, n long, h1 long, h2 long, sig binary", shingler.known)


def indexed(reps: DataFrame, rule: Rule) -> DataFrame:
    """(key, doc) for every class representative."""
    chunks = rule.chunks

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, sigs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
        s = np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), chunks, CHUNK).astype(np.uint64)
        keys = np.empty((len(sigs), chunks, CHUNK), np.uint64)
        for c in range(chunks):
            for drop in range(CHUNK):
                h = np.full(len(sigs), c * CHUNK + drop + 1, np.uint64)
                for k in range(CHUNK):
                    if k != drop:
                        h = (h ^ s[:, c, k]) * ODD
                        h ^= h >> np.uint64(31)
                keys[:, c, drop] = h
        return pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, chunks * CHUNK))], names=["key", "doc"])

    return per_batch(reps.select("doc", "sig"), run, "key long, doc long")


def near_signatures(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b, n_a, n_b) whose signatures and sizes allow the similarity."""
    slots, distance = rule.slots, rule.distance

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, slots) for i in (2, 3))
        n, m = (b.column(i).to_numpy() for i in (4, 5))
        near = ((x != y).sum(axis=1) <= distance) & rule.sizes_allow(n, m)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(near))

    return per_batch(pairs.select("a", "b", "sig_a", "sig_b", "n_a", "n_b"), run, "a long, b long")


def with_signatures(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    one = reps.select(F.col("doc").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    two = reps.select(F.col("doc").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    return pairs.join(one, "a").join(two, "b")


def confirm(pairs: DataFrame, docs: DataFrame, scratch: Scratch, rule: Rule) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= percent * union.  ``docs``: doc, text of representatives' ids."""
    wanted = scratch.keep(pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct())
    full = shingle_sets(docs, wanted, scratch)
    both = pairs.join(full.select(F.col("doc").alias("a"), F.col("set").alias("set_a")), "a").join(full.select(F.col("doc").alias("b"), F.col("set").alias("set_b")), "b")

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for s, t in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
            merged = np.sort(np.concatenate([x, y]))
            same = int((merged[1:] == merged[:-1]).sum())
            good.append(100 * same >= rule.percent * (len(x) + len(y) - same))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    out = scratch.keep(per_batch(both.select("a", "b", "set_a", "set_b"), check, "a long, b long"))
    scratch.drop(full, wanted)
    return out


def shingle_sets(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, set) of the wanted ids: their shingles' hashes."""
    texts = join_checked(docs, wanted, ["doc"], "left_semi")
    shingler = Shingler()

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingler.shingles(t).tobytes() for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["doc", "set"])

    return scratch.keep(per_batch(texts, sets, "doc long, set binary", shingler.known), codec="none")


def prefixes(sets: DataFrame, scratch: Scratch, rule: Rule) -> DataFrame:
    """(key, doc, pos): the shingles of each set of which two similar sets share one, and their places in the order.

    The order is by hash, with up to ``COMMON`` shingles that most of these sets hold moved to the end, rarest first.
    """

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        s, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(n)], names=["s", "n"])

    often = scratch.keep(per_batch(sets, count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n > 2"))
    # the least power of two that at most COMMON shingles reach
    bins = {r[0]: r[1] for r in often.groupBy(F.floor(F.log2(F.col("n").cast("double")) + 1e-9).cast("int").alias("b")).count().collect()}  # at most 63 rows
    least, total = 64, 0
    while least and (total := total + bins.get(least - 1, 0)) <= COMMON:
        least -= 1
    rows = often.where(F.col("n") >= F.lit(2.0**least)).collect()  # at most COMMON rows
    place = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    common = sets.sparkSession.sparkContext.broadcast(np.array(sorted(place), np.int64))
    ranks = sets.sparkSession.sparkContext.broadcast(np.array([place[x] for x in sorted(place)], np.int64))

    def first(b: pa.RecordBatch) -> pa.RecordBatch:
        docs, keys, places = [], [], []
        for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            s = np.frombuffer(x.as_buffer(), np.int64)
            late = np.full(len(s), -1, np.int64)
            if len(common.value):
                at = np.minimum(np.searchsorted(common.value, s), len(common.value) - 1)
                late = np.where(common.value[at] == s, ranks.value[at], -1)
            size = len(s) - -(-rule.percent * len(s) // 100) + 1
            keys.append(s[np.lexsort((s, late))[:size]])
            docs.append(np.full(len(keys[-1]), d))
            places.append(np.arange(len(keys[-1])))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, docs, places)], names=["key", "doc", "pos"])

    return per_batch(sets, first, "key long, doc long, pos long")


def links_within(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, allowed, rule: Rule) -> list[tuple[int, int]]:
    """Places (x, y), x of ``left`` and y of ``right``, of sets that are similar; ``allowed(x)`` gives the y to look at.

    Intersections are counted for one x against all of ``right`` at a time.
    """
    sizes = np.array([len(s) for s in sets])
    names = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    held = np.zeros(int(names.max()) + 1, np.int64)
    pieces = [names[starts[y] : starts[y + 1]] for y in right]
    flat, at = np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes[right])[:-1]])
    place = {int(y): i for i, y in enumerate(right)}
    out = []
    for x in left:
        ys = allowed(x)
        if not len(ys):
            continue
        own = names[starts[x] : starts[x + 1]]
        held[own] = 1
        if len(ys) > 20:
            same = np.add.reduceat(held[flat], at)[[place[int(y)] for y in ys]]
        else:
            same = np.array([held[pieces[place[int(y)]]].sum() for y in ys])
        held[own] = 0
        out += [(int(x), int(y)) for y in ys[100 * same >= rule.percent * (sizes[x] + sizes[ys] - same)]]
    return out


#: A group in which members are compared: a shingle, a size class, and two blocks.
GROUP = ("key", "cls", "i", "j")
MEMBER = "key long, cls int, i int, j int, own int, low boolean, doc long, comp long, n long, sig binary"


def placed_in_blocks(members: DataFrame, rule: Rule, scratch: Scratch) -> tuple[DataFrame, int]:
    """Members (key, doc, comp, n, ...) dealt to the groups (key, cls, i, j) in which they are compared, and the tasks for them.

    Keys are first split by size class (a set may match one of its own or the next class: it is ``low`` in its own, and of two members
    that meet one is low, so a pair meets once), then dealt into blocks
    of about ``BLOCK``; each pair of blocks is one group. What lies in one component is not placed.
    The groups' counts are pre-aggregated; a hot key's members are dealt on from wherever they lie if the counts are broadcast, and
    otherwise by a join that adaptive execution may split, since the exchange by group follows it.
    """
    ratio = float(np.log(100 / rule.percent))
    cls = F.floor(F.log(F.col("n").cast("double")) / ratio + 1e-9).cast("int")
    both = F.array(F.struct(cls.alias("cls"), F.lit(True).alias("low")), F.struct((cls + 1).alias("cls"), F.lit(False).alias("low")))
    sized = members.withColumn("_class", F.explode(both)).withColumns({"cls": F.col("_class.cls"), "low": F.col("_class.low")}).drop("_class")
    live = sized.groupBy("key", "cls").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    live = scratch.keep(live.select("key", "cls", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    rows = live.agg(F.coalesce(F.sum(F.col("m") * F.col("blocks")), F.lit(0))).first()[0]
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_MEMBERS))
    placed = join_checked(sized, live.drop("m"), ["key", "cls"], "inner", LIVE_BYTES).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    # a member of block i meets every block j: the group (i, j) with i <= j
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")
    return placed.repartition(tasks, *GROUP), tasks


class Group:
    """The arrays of one group, and which members of its right side a left one has to meet."""

    def __init__(self, t: pa.Table, rule: Rule):
        self.rule, self.distance = rule, rule.distance
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        self.own, self.doc, self.comp, self.n = (t.column(c).to_numpy() for c in ("own", "doc", "comp", "n"))
        self.low = t.column("low").to_numpy()
        self.sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, rule.slots)
        self.left, self.right, self.same = np.flatnonzero(self.own == i), np.flatnonzero(self.own == j), i == j

    def allowed(self, x: int, among: np.ndarray | None = None) -> np.ndarray:
        y, n = self.right if among is None else among, self.n
        y = y[(self.comp[y] != self.comp[x]) & (self.low[y] | self.low[x]) & self.rule.sizes_allow(n[y], n[x])]
        y = y[self.doc[y] > self.doc[x]] if self.same else y
        return y[(self.sig[y] != self.sig[x]).sum(axis=1) <= self.distance] if len(y) else y

    def pairs(self, found: list[tuple[int, int]]) -> pa.Table:
        made = [sorted((int(self.doc[x]), int(self.doc[y]))) for x, y in found]
        return pa.table({"a": pa.array([p[0] for p in made], pa.int64()), "b": pa.array([p[1] for p in made], pa.int64())})


def links_at_home(members: DataFrame, sets: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Links (a, b) between members (key, doc, comp, n, sig) of one home; only links that full sets (doc, set) confirm are emitted.

    First signatures are compared, and the members (not the pairs) that found a partner are emitted; only their sets travel.
    """

    def partnered(t: pa.Table) -> pa.Table:
        g = Group(t, rule)
        met = np.zeros(len(g.doc), bool)
        for x in g.left:
            y = g.allowed(x)
            if len(y):
                met[x] = met[y] = True
        return t.filter(pa.array(met))

    def compare(t: pa.Table) -> pa.Table:
        g = Group(t, rule)
        sets = [np.frombuffer(x, np.int64) for x in t.column("set").to_pylist()]
        return g.pairs(links_within(sets, g.left, g.right, g.allowed, rule) if len(g.left) and len(g.right) else [])

    names = [x.split()[0] for x in MEMBER.split(", ")]
    placed, tasks = placed_in_blocks(members, rule, scratch)
    alive = scratch.keep(placed.select(names).groupBy(*GROUP).applyInArrow(partnered, MEMBER))
    with_sets = alive.join(sets, "doc").select(*names, "set").repartition(tasks, *GROUP)
    return with_sets.groupBy(*GROUP).applyInArrow(compare, "a long, b long").distinct()


def pairs_abroad(members: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Candidate pairs (a, b) between members (key, doc, pos, comp, n, sig, first, last) of one key that share no home.

    A pair is emitted only where its key may be the first that the two share: of what stands behind it in either set, enough must be left for
    the similarity. The first shared key of a similar pair always passes, so none is lost.
    """

    def compare(t: pa.Table) -> pa.Table:
        g = Group(t, rule)
        first, last, pos = (t.column(c).to_numpy() for c in ("first", "last", "pos"))
        left = g.n - pos  # the key and what stands behind it
        found = []
        for x in g.left:
            y = g.right
            met = (first[y] == first[x]) | (first[y] == last[x]) | (last[y] == first[x]) | (last[y] == last[x])
            enough = (100 + rule.percent) * np.minimum(left[x], left[y]) >= rule.percent * (g.n[x] + g.n[y])
            found += [(int(x), int(z)) for z in g.allowed(x, y[enough & ~met])]
        return g.pairs(found)

    placed, _ = placed_in_blocks(members, rule, scratch)
    placed = placed.select(*GROUP, "own", "low", "doc", "pos", "comp", "n", "sig", "first", "last")
    return placed.groupBy(*GROUP).applyInArrow(compare, "a long, b long").distinct()


def link_documents(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, Scratch]:
    """(rows, components, scratch): rows (doc_id, n, doc) name each row's class, components are (node, comp) over classes.

    A class (equal shingle sets) is named by its smallest id.
    """
    spark, rule = docs.sparkSession, Rule(percent)
    scratch = Scratch(spark, "neardup")
    sketches = scratch.keep(sketch(docs, rule))
    linked = sketches.where("n > 0 AND doc_id IS NOT NULL")
    reps = scratch.keep(linked.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.count("*").alias("m")))
    keyed = scratch.keep(indexed(reps, rule))
    buckets = keyed.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    members = scratch.keep(keyed.join(buckets.select("key", "least"), "key"))
    scratch.drop(keyed)
    stars = scratch.keep(members.where("doc > least").select(F.col("least").alias("a"), F.col("doc").alias("b")).distinct())
    texts = docs.select(docs["doc_id"].cast("long").alias("doc"), "text")
    first = confirm(scratch.keep(near_signatures(with_signatures(stars, reps), rule)), texts, scratch, rule)
    # members of one bucket that are still apart
    comps = scratch.keep(connected_components(first, scratch))
    labelled = members.join(comps.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("comp", "doc").alias("comp"))
    labelled = scratch.keep(labelled)
    live = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo < hi AND m > 2").select("key")
    apart = scratch.keep(labelled.join(live, "key", "left_semi").select("doc", "comp").distinct())
    sets = shingle_sets(texts, apart.select("doc"), scratch)
    keyed = scratch.keep(prefixes(sets, scratch, rule).join(apart, "doc"))
    # a shingle that one component alone holds in its prefixes makes no pair
    several = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "m")
    keyed = scratch.keep(keyed.join(several, "key"))
    # a set's homes are its two largest groups: sets travel there only, and pairs that share a home are settled there
    largest = F.max(F.struct("m", "key")).alias("a")
    one = keyed.groupBy("doc").agg(largest).select("doc", F.col("a.key").alias("first"))
    two = keyed.join(one, "doc").where("key <> first").groupBy("doc").agg(largest).select("doc", F.col("a.key").alias("last"))
    homes = scratch.keep(one.join(two, "doc", "left").withColumn("last", F.coalesce("last", "first")))
    known = apart.join(reps.select("doc", "n", "sig"), "doc")
    at_home = homes.select("doc", F.explode(F.array_distinct(F.array("first", "last"))).alias("key"))
    settled = scratch.keep(links_at_home(at_home.join(known, "doc"), sets, rule, scratch))
    # what the homes have linked is one component now, and is not compared abroad again
    comps = scratch.keep(connected_components(first.union(settled), scratch))
    known = known.drop("comp").join(comps.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    abroad = keyed.select("key", "doc", "pos").join(known, "doc").join(homes, "doc")
    second = settled.union(confirm(scratch.keep(pairs_abroad(abroad, rule, scratch)), texts, scratch, rule))
    # rows take their class's name; only classes of several rows need a join
    several = reps.where("m > 1").select("h1", "h2", "n", "doc")
    rows = linked.join(several, ["h1", "h2", "n"], "left").select("doc_id", "n", F.coalesce("doc", "doc_id").alias("doc"))
    rows = scratch.keep(rows.union(sketches.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", "doc_id")))
    # an id that repeats with different texts ties their classes together
    tied = scratch.keep(rows.groupBy("doc_id").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi"))
    same = rows.join(tied.select("doc_id", "lo"), "doc_id").where("doc <> lo").select(F.col("lo").alias("a"), F.col("doc").alias("b"))
    comps = scratch.keep(connected_components(first.union(second).union(same), scratch))
    scratch.drop(members, labelled, stars, reps, sketches)
    return rows, comps, scratch


def components_of(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    rows, comps, _ = link_documents(docs, percent)
    comp = F.coalesce("comp", "doc")
    return rows.join(comps.withColumnRenamed("node", "doc"), "doc", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one of smallest id, with all its columns; rows that repeat its id become one row.

    Documents without words and rows with a null id all stay, repeated or not; an empty table stays empty.
    """
    rows, comps, scratch = link_documents(docs, percent)
    named = rows.where("doc_id IS NOT NULL AND n > 0").join(comps.withColumnRenamed("node", "doc"), "doc", "left")
    gone = scratch.keep(named.where(F.coalesce("comp", "doc") < F.col("doc_id")).select("doc_id").distinct())
    left = join_checked(docs, gone, ["doc_id"], "left_anti")
    again = scratch.keep(rows.where("n > 0").groupBy("doc_id").count().where("count > 1").select("doc_id").join(gone, "doc_id", "left_anti"))
    if again.isEmpty():
        return left
    # an aggregate, not a window: copies of a hot id meet as partial results
    one = join_checked(left, again, ["doc_id"], "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("r")).select("r.*")
    return join_checked(left, again, ["doc_id"], "left_anti").unionByName(one)
