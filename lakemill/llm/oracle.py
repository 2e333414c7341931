"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 49) AS k FROM d, unnest(range(1, len(w) - 48)) AS r(i)),
firsts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS f FROM win),
gone AS (SELECT DISTINCT doc_id, p FROM firsts, unnest(range(i, i + 50)) AS r(p) WHERE f < doc_id),
placed AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""

def _crc_step(value: int) -> int:
    for _ in range(4):
        value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
    return value


#: CRC-32 over half bytes, the low half of each byte first.
_CRC_TABLE = str([_crc_step(i) for i in range(16)])

SHARDS = f"""
WITH raw AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
halves AS (SELECT doc_id, source, strlen(t) + 1 AS size, list_transform(string_split(hex(encode(t)), ''), lambda c: CAST(strpos('0123456789ABCDEF', c) - 1 AS BIGINT)) AS h FROM raw),
swapped AS (SELECT doc_id, source, size, CASE WHEN size = 1 THEN [] ELSE list_transform(range(1, 2 * size - 1), lambda i: h[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) END AS h FROM halves),
summed AS (SELECT doc_id, source, size, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), h), lambda a, b: xor(a >> 4, {_CRC_TABLE}[xor(a, b) % 16 + 1])), 4294967295) AS BIGINT) AS crc FROM swapped),
r AS (SELECT *, coalesce('s' || source, '') AS stratum,
  row_number() OVER (PARTITION BY source ORDER BY md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size, crc) AS rank, count(*) OVER (PARTITION BY source) AS n FROM summed),
p AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * rank - 1 AS DOUBLE) / (2 * n), stratum, doc_id, size, crc) - 1 AS position, count(*) OVER () AS total FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(position * 16 // total AS INT) AS shard,
  CAST(position - (position * 16 // total * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM p"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS k FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.id, edges.b FROM reach JOIN edges ON edges.a = reach.other),
least AS (SELECT id, min(other) AS c FROM reach GROUP BY id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM d JOIN least ON id = doc_id LEFT JOIN n USING (doc_id)"""

MIX = """
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT source, n, CAST(floor(sqrt(n * 1e12)) AS HUGEINT) AS m, row_number() OVER (ORDER BY source) AS k, CAST((n + 3) // 4 AS BIGINT) AS blocks FROM c),
h AS (SELECT list(m ORDER BY k) AS ms, list(blocks ORDER BY k) AS bs, CAST(sum(m) AS HUGEINT) AS h, CAST(sum(blocks) AS BIGINT) AS total FROM t),
run(slot, done, k, count) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ms, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM h
  UNION ALL
  SELECT slot + 1, list_transform(range(1, len(ms) + 1), lambda i: done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), coalesce(pick, 0), count + CASE WHEN pick > 0 THEN 1 ELSE 0 END FROM (
    SELECT slot, done, count, ms, h, CAST(list_aggregate(list_transform(list_filter(range(1, len(ms) + 1), lambda i: done[i] < bs[i] AND done[i] * h // ms[i] <= slot + 1),
      lambda i: -(-(done[i] + 1) * h // ms[i]) * 100000 + i), 'min') % 100000 AS BIGINT) AS pick FROM run, h WHERE count < total)
),
plan AS (SELECT slot, k, done[k] AS j FROM run WHERE k > 0),
r AS (SELECT doc_id, source, t.k, m, h, (row_number() OVER (PARTITION BY source ORDER BY md5('23:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1) AS rank FROM documents JOIN t USING (source), h),
s AS (SELECT r.*, rank // 4 AS block, plan.slot AS tick FROM r JOIN plan ON plan.k = r.k AND plan.j = rank // 4 + 1),
gap AS (SELECT min(blocks * h // m) AS g FROM t, h)
SELECT doc_id, source, CAST(m AS DOUBLE) / CAST(h AS DOUBLE) AS target_weight, CAST(block AS BIGINT) AS block, CAST(tick AS BIGINT) AS slot,
  CAST(row_number() OVER (ORDER BY tick, rank) - 1 AS BIGINT) AS position, tick < g AS on_target
FROM s, gap"""

TOOL_CALLS = """
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS t,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'plain' END AS kind,
    CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id FROM conversations),
e AS (SELECT m.*, CASE WHEN call_id IS NULL THEN 'plain' WHEN EXISTS (SELECT 1 FROM m o WHERE o.conv_id = m.conv_id AND o.call_id = m.call_id AND o.kind <> m.kind) THEN 'linked'
    WHEN kind = 'call' THEN 'unanswered' ELSE 'orphan' END AS status,
  CASE WHEN kind = 'call' AND t = '' THEN '$.text: length' END AS error, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM m)
SELECT conv_id, turn, CAST(0 AS INT) AS seq, role, kind, call_id, status, error IS NULL AS valid, error, CAST(position AS BIGINT) AS position,
  '{"body":' || CASE WHEN kind = 'call' THEN '{"text":' || to_json(t) || '}' ELSE to_json(t) END
  || CASE WHEN call_id IS NOT NULL THEN ',"id":' || to_json(call_id) ELSE '' END || ',"kind":"' || kind || '"' || CASE WHEN kind = 'call' THEN ',"name":"reply"' ELSE '' END
  || ',"position":' || position || ',"role":' || to_json(role) || ',"status":"' || status || '"}' AS message
FROM e"""
