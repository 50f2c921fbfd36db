"""SQL oracles of the contract queries that SQL can express."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

RULES = rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
again AS (SELECT id, g FROM p GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT id, count(DISTINCT i + k) AS n FROM p JOIN again USING (id, g), (SELECT unnest(range(5)) AS k) GROUP BY id),
l AS (SELECT id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN l USING (id) LEFT JOIN covered USING (id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR 100 * n_symbols > 10 * word_chars OR n_dup_lines > 3) AS failed FROM f GROUP BY 1),
o AS (SELECT sum(failed) / sum(n) AS m, sum(failed * failed / n) / sum(n) - pow(sum(failed) / sum(n), 2) AS v, count(*) / sum(n) AS inv FROM h),
b AS (SELECT m, greatest(1.0, least(1e6, m * (1 - m) / greatest(v - m * (1 - m) * inv, 1e-12) - 1)) AS w FROM o),
bad AS (SELECT source FROM h, b WHERE (failed + m * w) / (n + w) > 0.5)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept FROM f"""

NEARDUP = rf"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 85 * (p.n + q.n - m)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT b, seen FROM r JOIN both_ways ON a = node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, comp AS component_id, doc_id = comp AS kept
FROM (SELECT node AS doc_id, min(seen) AS comp FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)"""

#: Marks hold 17 characters a turn; each escaped character becomes two.
CHAT = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(17 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')))::BIGINT AS formatted_chars,
  string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '-' END, '' ORDER BY turn NULLS FIRST, role, text) AS roles FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  regexp_full_match(roles, 's?(ua)+') AS valid FROM g"""

SQL: dict[str, str] = {"op2_exact_topk": TOPK, "op5_quality_rules": RULES, "op6_minhash_neardup": NEARDUP, "op7_chat_formatting": CHAT}
