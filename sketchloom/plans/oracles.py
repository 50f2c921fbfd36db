"""DuckDB SQL of the catalogue's deterministic queries, written from the sketches' definitions."""

from __future__ import annotations

from ..hashing import BITS, duck_half, duck_nth
from ..operators.ordered import SHARDS
from ..params import dedup_hashes, hll_alpha
from . import catalogue as c


def _words(source: str, key: str, spec, group: str = "") -> str:
    g = f"{group}, " if group else ""
    at = f"{duck_nth('a', 'b', 'i')} % {spec.partition_bits}" + (f" + i * {spec.partition_bits}" if spec.partitioned else "")
    return f"""SELECT {g}pos // 32 AS word_idx, bit_or(1::BIGINT << (pos % 32)) AS word FROM (
      SELECT {g}{at} AS pos FROM (SELECT DISTINCT {g}{duck_half("k", 0)} AS a, {duck_half("k", 1)} AS b
        FROM (SELECT {g}{key}::VARCHAR AS k FROM {source}) WHERE k IS NOT NULL), (SELECT unnest(range({spec.hashes})) AS i)) GROUP BY ALL"""


def _bloom_stats(words: str, spec) -> str:
    return f"""SELECT {spec.bits}::BIGINT AS bits, {spec.hashes}::BIGINT AS hashes, ones, {spec.bits} - ones AS zeros,
      round(pow(ones / {float(spec.bits)}, {float(spec.hashes)}), 9) AS estimated_fpp, ones > 0 AS has_items
      FROM (SELECT coalesce(sum(bit_count(word)), 0)::BIGINT AS ones FROM ({words}))"""


def _bloom_probe(probed: str, columns: str, key: str, words: str, spec) -> str:
    at = f"{duck_nth('a', 'b', 'i')} % {spec.partition_bits}" + (f" + i * {spec.partition_bits}" if spec.partitioned else "")
    return f"""WITH w AS ({words}), keys AS (SELECT DISTINCT {key}::VARCHAR AS k FROM {probed}),
      pos AS (SELECT k, {at} AS pos FROM (SELECT k, {duck_half("k", 0)} AS a, {duck_half("k", 1)} AS b FROM keys), (SELECT unnest(range({spec.hashes})) AS i)),
      v AS (SELECT k, bool_and(coalesce(word, 0) & (1::BIGINT << (pos % 32)) <> 0) AS found FROM pos LEFT JOIN w ON word_idx = pos // 32 GROUP BY k)
      SELECT {columns}, found FROM {probed} JOIN v ON k = {key}::VARCHAR"""


def _cuckoo(source: str, extra: str = "") -> str:
    s = c.CUCKOO
    return f"""SELECT {extra}fingerprint, least(i1, xor(i1, {duck_half("fingerprint::VARCHAR", 0)} % {s.buckets})) AS min_bucket FROM (
      SELECT *, CASE WHEN a % {1 << s.fingerprint_bits} = 0 THEN 1 ELSE a % {1 << s.fingerprint_bits} END AS fingerprint, b % {s.buckets} AS i1 FROM (
      SELECT p_partkey, {duck_half("k", 0)} AS a, {duck_half("k", 1)} AS b FROM (SELECT p_partkey, p_partkey::VARCHAR AS k FROM {source})))"""


def _quotient(source: str, key: str, s, extra: str = "") -> str:
    return f"""SELECT {extra}(a >> {s.remainder_bits}) % {s.capacity} AS quotient, a % {1 << s.remainder_bits} AS remainder FROM (
      SELECT {key}, {duck_half("k", 0)} AS a FROM (SELECT {key}, {key}::VARCHAR AS k FROM {source}))"""


def _cells(source: str, key: str, weight: str) -> str:
    s = c.GRID
    return f"""SELECT i AS row, {duck_nth("a", "b", "i")} % {s.cols} AS col, sum(w)::BIGINT AS cnt FROM (
      SELECT {duck_half("k", 0)} AS a, {duck_half("k", 1)} AS b, w FROM (SELECT {key}::VARCHAR AS k, {weight} AS w FROM {source})), (SELECT unnest(range({s.rows})) AS i) GROUP BY ALL"""


def _estimates(keys: str, key: str, cells: str, value: str, columns: str) -> str:
    s = c.GRID
    return f"""WITH g AS ({cells}), t AS (SELECT coalesce(sum(cnt), 0)::BIGINT AS total FROM g WHERE row = 0),
      asked AS (SELECT DISTINCT {key} AS key, {duck_half(f"{key}::VARCHAR", 0)} AS a, {duck_half(f"{key}::VARCHAR", 1)} AS b FROM {keys}),
      v AS (SELECT key, coalesce(cnt, 0) AS cnt, total, coalesce(cnt, 0) - ceil((total - coalesce(cnt, 0)) / {s.cols - 1})::BIGINT AS less
        FROM asked CROSS JOIN (SELECT unnest(range({s.rows})) AS i) CROSS JOIN t LEFT JOIN g ON row = i AND col = {duck_nth("a", "b", "i")} % {s.cols})
      SELECT {columns}, {value} AS estimate FROM v GROUP BY key"""


def _registers(source: str, key: str, group: str = "") -> str:
    g, p = (f"{group}, " if group else ""), c.P
    return f"""SELECT {g}h % {1 << p} AS register, max(length(bin(((h >> {p}) + 1) & ~(h >> {p}))))::BIGINT AS rho FROM (
      SELECT {g}{duck_half("k", 0)} AS h FROM (SELECT {g}{key}::VARCHAR AS k FROM {source}) WHERE k IS NOT NULL) GROUP BY ALL"""


def _hll(registers: str, group: str = "") -> str:
    p, g = c.P, (f"{group}, " if group else "")
    m, top = 1 << p, BITS + 1 - p
    by = f"GROUP BY {group}" if group else ""
    return f"""SELECT {g}round(CASE WHEN raw <= {2.5 * m} AND zeros > 0 THEN {float(m)} * ln({float(m)} / zeros) ELSE raw END, 6) AS estimate FROM (
      SELECT {g}zeros, {hll_alpha(p) * m * m * 2.0**top!r} / (s + zeros * {1 << top})::DOUBLE AS raw FROM (
      SELECT {g}{m} - count(*) AS zeros, coalesce(sum(1::BIGINT << ({top} - rho)), 0)::BIGINT AS s FROM ({registers}) {by}))"""


SHINGLES = f"""SELECT doc_id, array_to_string(list_slice(t, i, i + {c.WIDTH - 1}), ' ') AS shingle FROM (
  SELECT doc_id, t, unnest(range(1, len(t) - {c.WIDTH - 2})) AS i FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents) WHERE len(t) >= {c.WIDTH})"""
MINIMA = ", ".join(f"min({duck_nth('a', 'b', str(i))})" for i in range(c.HASHES))
SIGNATURES = f"""SELECT doc_id, [{MINIMA}] AS s FROM (SELECT doc_id, {duck_half("shingle", 0)} AS a, {duck_half("shingle", 1)} AS b FROM ({SHINGLES})) GROUP BY doc_id"""
PLACES = " + ".join(f"CASE WHEN count(*) - 2 * sum((h >> {i}) & 1) >= 0 THEN {1 << (BITS - 1 - i)}::BIGINT ELSE 0 END" for i in range(BITS))
SIMHASH = f"""SELECT doc_id, ({PLACES})::BIGINT AS sim_hash FROM (SELECT doc_id, {duck_half("shingle", 0)} AS h FROM ({SHINGLES})) GROUP BY doc_id"""

BUILDING = "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"
CLICK, PURCHASE = (f"(SELECT user_id FROM events WHERE event_type = '{k}')" for k in ("click", "purchase"))
SMALL = "(SELECT p_partkey FROM part WHERE p_size <= {})"
PROBE = _bloom_probe("orders", "o_orderkey, o_custkey", "o_custkey", _words(BUILDING, "c_custkey", c.BUILDING), c.BUILDING)
LINES = _cells("lineitem", "l_suppkey", "l_quantity::BIGINT")
EVENTS = _registers("events", "user_id", "event_type")
CUCKOO_SET, QUOTIENT_SET = f"SELECT DISTINCT * FROM ({_cuckoo(SMALL.format(25))})", f"SELECT DISTINCT * FROM ({_quotient(SMALL.format(25), 'p_partkey', c.QUOTIENT)})"
FLAGS = _registers("lineitem", "l_partkey", "l_returnflag, l_linestatus")


def _supplier(value: str) -> str:
    return _estimates("supplier", "s_suppkey", LINES, value, "key AS s_suppkey")


def _layout() -> str:
    """The filter's size follows from the table's rows, as in the query."""
    least, r = c.QUOTIENT_SMALL.quotient_bits, c.QUOTIENT_SMALL.remainder_bits
    return f"""WITH z AS (SELECT 1::BIGINT << greatest({least}, ceil(log2(1.33 * greatest(count(*), 1)))::INTEGER) AS size FROM supplier),
      p AS (SELECT DISTINCT (a >> {r}) % size AS quotient, a % {1 << r} AS remainder FROM (SELECT {duck_half("s_suppkey::VARCHAR", 0)} AS a FROM supplier), z),
      d AS (SELECT quotient, remainder, turn, quotient + turn * size AS q FROM p, z, (SELECT unnest([0, 1]) AS turn)),
      k AS (SELECT *, row_number() OVER (ORDER BY q, remainder) - 1 AS k FROM d),
      l AS (SELECT *, k + max(q - k) OVER (ORDER BY q, remainder ROWS UNBOUNDED PRECEDING) AS slot FROM k)
      SELECT slot % size AS slot, quotient, remainder, (slot % size) IN (SELECT quotient FROM p) AS is_occupied,
      row_number() OVER (PARTITION BY quotient ORDER BY remainder) > 1 AS is_continuation, slot % size <> quotient AS is_shifted FROM l, z WHERE turn = 1"""


def _marked(columns: str, keyed: str, stored: str, pair: tuple[str, str]) -> str:
    x, y = pair
    return f"SELECT {columns}, s.{x} IS NOT NULL AS found FROM ({keyed}) k LEFT JOIN ({stored}) s ON k.{x} = s.{x} AND k.{y} = s.{y}"


def _shard(key: str) -> str:
    return f"({duck_half(key, 1, 'shard:')} % {SHARDS})"


def _most(n: int = 24) -> tuple[list[int], list[int]]:
    """Bits and hashes of the first layers of the growing filter."""
    like, bits, hashes = c.BLOOM_LAYERS, [], []
    for i in range(n):
        layer = like._layer(bits[-1] * 2 if bits else like.initial_bits, like.fpp * like.tightening**i)
        bits.append(layer.bits)
        hashes.append(layer.hashes)
        if bits[-1] > 1 << 20:
            break
    return bits, hashes


def _grown() -> str:
    """Shards, each with its number of layers and the places that are set (layer * 2^32 + bit), one key after the other.

    Only a key's first insertion can change anything, so a key counts once.
    """
    bits, hashes = _most()
    places = lambda layer, count: f"list_transform(range({count}), lambda i: {layer} * 4294967296 + (a + i * b + i * (i - 1) * (i - 2) // 6) % (({bits}::BIGINT[])[{layer} + 1]))"
    known = f"list_bool_or(list_transform(range(n), lambda l: list_has_all(held, {places('l', f'({hashes})[l + 1]')})))"
    return f"""k AS (SELECT DISTINCT l_orderkey AS id, l_orderkey::VARCHAR AS k FROM lineitem WHERE l_quantity <= 20),
      e AS (SELECT id, {_shard("k")}::INTEGER AS shard, {duck_half("k", 0)} AS a, {duck_half("k", 1)} AS b FROM k),
      o AS (SELECT shard, a, b, row_number() OVER (PARTITION BY shard ORDER BY id) AS seq FROM e),
      g AS (SELECT DISTINCT shard, 0::BIGINT AS seq, 1::BIGINT AS n, []::BIGINT[] AS held FROM o UNION ALL
        SELECT shard, seq, CASE WHEN 2 * len(list_filter(now, lambda x: x // 4294967296 = n - 1)) >= ({bits}::BIGINT[])[n] THEN n + 1 ELSE n END, now FROM (
          SELECT g.shard, o.seq, n, CASE WHEN {known} THEN held ELSE list_distinct(held || {places("(n - 1)", f"({hashes})[n]")}) END AS now
          FROM g JOIN o ON o.shard = g.shard AND o.seq = g.seq + 1)),
      f AS (SELECT shard, n, held, {bits}::BIGINT[] AS bits, {hashes}::INTEGER[] AS hashes FROM g QUALIFY row_number() OVER (PARTITION BY shard ORDER BY seq DESC) = 1)"""


def _layers() -> str:
    return f"""WITH RECURSIVE {_grown()}, l AS (SELECT shard, unnest(range(n)) AS layer, bits, hashes, held FROM f),
      m AS (SELECT shard, layer::INTEGER AS layer, bits[layer + 1] AS slots, hashes[layer + 1] AS width, len(list_filter(held, lambda x: x // 4294967296 = layer))::BIGINT AS held FROM l)
      SELECT shard, layer, slots, width, held, 0::BIGINT AS overflow, round(pow(held / slots, width), 9) AS estimated_fpp FROM m"""


def _grown_contains() -> str:
    place = "layer * 4294967296 + (a + i * b + i * (i - 1) * (i - 2) // 6) % bits[layer + 1]"
    return f"""WITH RECURSIVE {_grown()},
      q AS (SELECT o_orderkey, k, {_shard("k")} AS shard, {duck_half("k", 0)} AS a, {duck_half("k", 1)} AS b FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS k FROM orders))
      SELECT o_orderkey, coalesce(list_bool_or(list_transform(range(n), lambda layer: list_has_all(held, list_transform(range(hashes[layer + 1]), lambda i: {place})))), false) AS found
      FROM q LEFT JOIN f ON f.shard = q.shard"""


def _dedup(rule: str) -> str:
    """One order of each shard after the other: the places that are set (partition * bits + bit) and the number of resets so far."""
    n, k = c.DEDUP_BITS, dedup_hashes(0.01)
    draw = lambda *parts: f"""('0x' || substr(md5({" || '/' || ".join(["''", "shard", "(step + 1)", *parts])}), 1, 12))::BIGINT"""
    gone = {
        "bs": f"list_transform(range({k}), lambda i: i * {n} + {draw(chr(39) + 'bit' + chr(39), 'i')} % {n})",
        "bssd": f"[{draw(chr(39) + 'part' + chr(39))} % {k} * {n} + {draw(chr(39) + 'bit' + chr(39))} % {n}]",
        "rlbs": f"""list_transform(list_filter(range({k}), lambda i: {draw(chr(39) + 'chance' + chr(39), 'i')} % {n} < len(list_filter(held, lambda x: x // {n} = i))),
          lambda i: i * {n} + {draw(chr(39) + 'bit' + chr(39), 'i')} % {n})""",
    }[rule]
    return f"""WITH RECURSIVE e AS (SELECT o_orderkey, k, {_shard("k")}::INTEGER AS shard, {duck_half("k", 0)} AS a, {duck_half("k", 1)} AS b FROM (
        SELECT o_orderkey, o_custkey::VARCHAR AS k FROM orders) WHERE k IS NOT NULL),
      o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY o_orderkey, k) AS seq, list_transform(range({k}), lambda i: i * {n} + (a + i * b + i * (i - 1) * (i - 2) // 6) % {n}) AS own FROM e),
      g AS (SELECT DISTINCT shard, 0::BIGINT AS seq, 0::BIGINT AS step, []::BIGINT[] AS held, NULL::BIGINT AS o_orderkey, NULL::VARCHAR AS item, NULL::BOOLEAN AS is_distinct FROM o UNION ALL
        SELECT shard, seq, step + is_new::INTEGER, CASE WHEN is_new THEN list_distinct(list_filter(held, lambda x: NOT list_contains(gone, x)) || own) ELSE held END, o_orderkey, k, is_new FROM (
          SELECT *, CASE WHEN is_new THEN {gone} ELSE []::BIGINT[] END AS gone FROM (
            SELECT g.shard, o.seq, step, held, o.o_orderkey, k, own, NOT list_has_all(held, own) AS is_new FROM g JOIN o ON o.shard = g.shard AND o.seq = g.seq + 1)))
      SELECT o_orderkey, item, shard, is_distinct FROM g WHERE seq > 0"""


_f = 2.0**c.CUCKOO.fingerprint_bits
_low = (1 << BITS) - 1
_level = {
    0: _hll(FLAGS, "l_returnflag, l_linestatus"),
    1: _hll(_registers("lineitem", "l_partkey", "l_returnflag"), "l_returnflag"),
    2: _hll(_registers("lineitem", "l_partkey")),
}

SQL: dict[str, str] = {
    "bloom_words": _words("customer", "c_custkey", c.CUSTOMERS),
    "bloom_stats": _bloom_stats(_words("customer", "c_custkey", c.CUSTOMERS), c.CUSTOMERS),
    "bloom_probe": PROBE,
    "bloom_probe_by_join": PROBE,
    "bloom_semijoin": """SELECT o_orderstatus, count(*) AS n_lines, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem JOIN orders
      ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderstatus""",
    "bloom_union": _words("(SELECT user_id FROM events WHERE event_type IN ('click', 'purchase'))", "user_id", c.USERS),
    "bloom_intersect": f"""SELECT word_idx, x.word & y.word AS word FROM ({_words(CLICK, "user_id", c.USERS)}) x
      JOIN ({_words(PURCHASE, "user_id", c.USERS)}) y USING (word_idx) WHERE x.word & y.word <> 0""",
    "bloom_by_group": f"SELECT event_type, sum(bit_count(word))::BIGINT AS ones FROM ({_words('events', 'user_id', c.USERS, 'event_type')}) GROUP BY event_type",
    "pbloom_stats": _bloom_stats(_words(SMALL.format(10), "p_partkey", c.PARTS), c.PARTS),
    "pbloom_probe": _bloom_probe("part", "p_partkey", "p_partkey", _words(SMALL.format(10), "p_partkey", c.PARTS), c.PARTS),
    "cuckoo_fingerprints": CUCKOO_SET,
    "cuckoo_contains": _marked("p_partkey", _cuckoo("part", "p_partkey, "), CUCKOO_SET, ("fingerprint", "min_bucket")),
    "cuckoo_remove": f"{CUCKOO_SET} EXCEPT {_cuckoo(SMALL.format(5))}",
    "cuckoo_stats": f"""SELECT n AS stored, {c.CUCKOO.buckets}::BIGINT AS buckets, {c.CUCKOO.capacity}::BIGINT AS slots, greatest(n - {c.CUCKOO.capacity}, 0)::BIGINT AS overflow,
      n = 0 AS is_empty, n > {c.CUCKOO.capacity} AS is_nearly_full,
      round(1 - pow({(_f - 2) / (_f - 1)!r}, {2.0 * c.CUCKOO.entries} * least(n, {c.CUCKOO.capacity}) / {c.CUCKOO.capacity}), 9) AS estimated_fpp FROM (SELECT count(*) AS n FROM ({CUCKOO_SET}))""",
    "quotient_set": QUOTIENT_SET,
    "quotient_contains": _marked("p_partkey", _quotient("part", "p_partkey", c.QUOTIENT, "p_partkey, "), QUOTIENT_SET, ("quotient", "remainder")),
    "quotient_remove": f"{QUOTIENT_SET} EXCEPT {_quotient(SMALL.format(5), 'p_partkey', c.QUOTIENT)}",
    "quotient_stats": f"""SELECT n AS stored, {c.QUOTIENT.capacity}::BIGINT AS slots, n = 0 AS is_empty, n > {c.QUOTIENT.capacity} AS over_full,
      round(1 - exp(-(n / {float(c.QUOTIENT.capacity)}) / {2.0**c.QUOTIENT.remainder_bits}), 9) AS estimated_fpp FROM (SELECT count(*) AS n FROM ({QUOTIENT_SET}))""",
    "quotient_layout": _layout(),
    "cms_grid": LINES,
    "cms_min": _supplier("min(cnt)::BIGINT"),
    "cms_mean": _supplier(f"round(sum(cnt) / {c.GRID.rows})::BIGINT"),
    "cms_median_bias": _supplier(f"least(min(cnt), list_sort(list(less))[{(c.GRID.rows - 1) // 2 + 1}])::BIGINT"),
    "cms_remove": _cells("lineitem", "l_suppkey", "CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity::BIGINT END"),
    "cms_heavy_hitters": _estimates("(SELECT user_id::VARCHAR AS user_id FROM events)", "user_id", _cells("events", "user_id", "1"), "min(cnt)::BIGINT", "key AS item") + " ORDER BY estimate DESC, item LIMIT 20",
    "hll_registers": EVENTS,
    "hll_by_group": _hll(EVENTS, "event_type"),
    "hll_merge": _hll(_registers("(SELECT l_orderkey AS k0 FROM lineitem UNION ALL SELECT o_orderkey FROM orders)", "k0")),
    "hll_rollup": f"""SELECT l_returnflag, l_linestatus, 0::BIGINT AS level, estimate FROM ({_level[0]}) UNION ALL
      SELECT l_returnflag, NULL, 1, estimate FROM ({_level[1]}) UNION ALL SELECT NULL, NULL, 2, estimate FROM ({_level[2]})""",
    "hll_vs_exact": f"SELECT event_type, estimate, exact FROM ({_hll(EVENTS, 'event_type')}) JOIN (SELECT event_type, count(DISTINCT user_id) AS exact FROM events GROUP BY 1) USING (event_type)",
    "hll_daily_window": _hll(_registers("(SELECT strftime(ts, '%Y-%m-%d') AS day, user_id FROM events)", "user_id", "day"), "day"),
    "scalable_bloom_layers": _layers(),
    "scalable_bloom_contains": _grown_contains(),
    "bs_dedup": _dedup("bs"),
    "bssd_dedup": _dedup("bssd"),
    "rlbs_dedup": _dedup("rlbs"),
    "shingles": f"SELECT doc_id, count(*) AS n, count(DISTINCT shingle) AS n_distinct FROM ({SHINGLES}) GROUP BY doc_id",
    "jaccard_pairs": f"""WITH s AS (SELECT DISTINCT * FROM ({SHINGLES})), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      pairs AS (SELECT x.doc_id AS doc_a, y.doc_id AS doc_b FROM documents x JOIN documents y ON x.doc_id + 1 = y.doc_id),
      met AS (SELECT doc_a, count(*) AS m FROM pairs JOIN s x ON x.doc_id = doc_a JOIN s y ON y.doc_id = doc_b AND x.shingle = y.shingle GROUP BY 1)
      SELECT doc_a, doc_b, round(coalesce(m, 0) / nullif(coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(m, 0), 0), 9) AS jaccard
      FROM pairs LEFT JOIN n a ON a.doc_id = doc_a LEFT JOIN n b ON b.doc_id = doc_b LEFT JOIN met USING (doc_a)""",
    "minhash_signature": f"SELECT doc_id, array_to_string(s, ',') AS signature FROM ({SIGNATURES})",
    "minhash_similarity": f"""WITH s AS ({SIGNATURES}) SELECT x.doc_id AS doc_a, y.doc_id AS doc_b,
      round(len(list_filter(list_zip(x.s, y.s), lambda z: z[1] = z[2])) / {c.HASHES}, 9) AS similarity FROM s x JOIN s y ON x.doc_id + 1 = y.doc_id""",
    "simhash_fingerprint": SIMHASH,
    "simhash_hamming": f"WITH s AS ({SIMHASH}) SELECT x.doc_id AS doc_a, y.doc_id AS doc_b, bit_count(xor(x.sim_hash, y.sim_hash))::BIGINT AS distance FROM s x JOIN s y ON x.doc_id + 1 = y.doc_id",
    "simhash_candidates": f"""WITH s AS ({SIMHASH}), r AS (SELECT doc_id, rot, ((sim_hash % (1::BIGINT << ({BITS} - rot))) * (1::BIGINT << rot)) | (sim_hash >> ({BITS} - rot)) AS h
      FROM s, (SELECT unnest(range({BITS})) AS rot)), k AS (SELECT *, row_number() OVER (PARTITION BY rot ORDER BY h, doc_id) AS k FROM r)
      SELECT DISTINCT least(x.doc_id, y.doc_id) AS doc_a, greatest(x.doc_id, y.doc_id) AS doc_b FROM k x JOIN k y ON x.rot = y.rot AND y.k - x.k BETWEEN 1 AND 2""",
}
