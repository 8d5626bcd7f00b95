"""SQL twins (DuckDB) of importance resampling, quality rules and conversation repair."""

SQL: dict[str, str] = {}

#: CRC-32 by its byte table: ``ct.t`` holds the table, the macro folds a list of bytes.
_CRC_TABLE = """ct AS (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""


def _crc(byte_list: str) -> str:
    return f"xor(list_reduce([4294967295::BIGINT] || {byte_list}, lambda a, b: xor(a >> 8, ct.t[xor(a & 255, b) + 1])), 4294967295)"


_HEX_BYTES = "list_transform(range(1, length(h), 2), lambda i: (16 * (strpos('0123456789ABCDEF', substr(h, i, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, i + 1, 1)) - 1)::BIGINT)"
_ASCII_BYTES = "list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)"
_LOW = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL["op11_importance_resampling"] = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce({_LOW}, []) AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS g FROM d),
bw AS (SELECT unnest({_LOW}) AS g FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT g, hex(g) AS h FROM (SELECT g FROM dw UNION SELECT g FROM bw)),
k AS (SELECT g, {_crc(_HEX_BYTES)} % 10000 AS bucket FROM g, ct),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN k ON dw.g = k.g GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN k ON bw.g = k.g GROUP BY bucket),
a AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS sa, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS ta),
gain AS (SELECT bucket, floor(1000.0 * ln(((coalesce(t, 0) + 1)::DOUBLE * (sa + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * (ta + 10000))))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM k) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), a),
m AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM dw JOIN k ON dw.g = k.g JOIN gain USING (bucket) GROUP BY doc_id),
x AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, CASE WHEN n > 0 THEN ((total - ((total % n) + n) % n) // n)::BIGINT ELSE 0 END AS weight,
  floor(-1000.0 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS draw FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
y AS (SELECT doc_id, n_features, weight, weight + draw AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM r
"""


def _quality() -> str:
    from lumensift.llm.quality import FENCE, MAX_REPEAT_PERCENT, MIN_GROUP, MIN_WORDS, RULES, SKETCH_BITS

    values = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{r}' AS rule, (1000 * {n}) // {d} AS value FROM m WHERE NOT base_failed AND {d} > 0" for r, n, d, *_ in RULES)
    room = "CASE rule " + " ".join(f"WHEN '{r[0]}' THEN {r[4]}" for r in RULES) + " END"

    def level(name: str, *keys: str) -> str:
        group = ", ".join([*keys, "rule"])
        return f"""
{name}_r AS (SELECT {group}, bucket, sum(count(*)) OVER (PARTITION BY {group} ORDER BY bucket) AS upto, sum(count(*)) OVER (PARTITION BY {group}) AS size FROM v GROUP BY {group}, bucket),
{name}_q AS (SELECT {group}, max(size) AS size, min(bucket) FILTER (upto * 1000 >= 250 * size) AS q1, min(bucket) FILTER (upto * 1000 >= 500 * size) AS q2,
  min(bucket) FILTER (upto * 1000 >= 750 * size) AS q3 FROM {name}_r GROUP BY {group}),
{name} AS (SELECT {group}, size, least(q1 - {FENCE} * (q3 - q1), q2 - {room}) AS low,
  greatest(q3 + {FENCE} * (q3 - q1), q2 + {room}) + q3 // {1 << (SKETCH_BITS - 1)} + 1 AS high FROM {name}_q)"""
    two_sided = ", ".join(f"'{r[0]}'" for r in RULES if "low" in r[3])
    pick = lambda side: f"CASE WHEN l0.size >= {MIN_GROUP} THEN l0.{side} WHEN l1.size >= {MIN_GROUP} THEN l1.{side} ELSE l2.{side} END"
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
gg AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM gg WHERE n > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN ln ON d.doc_id = ln.doc_id),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
u AS ({values}),
v AS (SELECT *, (value >> greatest(0, length(bin(value)) - {SKETCH_BITS})) << greatest(0, length(bin(value)) - {SKETCH_BITS}) AS bucket FROM u),{level('l0', 'lang', 'source')},{level('l1', 'lang')},{level('l2')},
f AS (SELECT u.doc_id, count(*) FILTER (value > {pick('high')} OR (u.rule IN ({two_sided}) AND value < {pick('low')})) AS bad
  FROM u JOIN l0 ON u.lang IS NOT DISTINCT FROM l0.lang AND u.source IS NOT DISTINCT FROM l0.source AND u.rule = l0.rule
  JOIN l1 ON u.lang IS NOT DISTINCT FROM l1.lang AND u.rule = l1.rule JOIN l2 ON u.rule = l2.rule GROUP BY u.doc_id)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(bad, 0) = 0 AS kept FROM m LEFT JOIN f ON m.doc_id = f.doc_id
"""


SQL["op12_adaptive_quality"] = _quality()

SQL["op13_conversation_repair"] = f"""
WITH RECURSIVE {_CRC_TABLE},
n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc(_ASCII_BYTES)} % 20 AS k FROM conversations, ct),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM n WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
f AS (SELECT *, substr(role, 1, 1) AS x, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE 'k' END AS fault FROM o),
e AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS px FROM f),
st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM e GROUP BY conv_id),
ins(s, put, t, c) AS (VALUES ('O', '', 'O', 0), ('O', 'I', 'A', 3), ('O', 'II', 'U', 6), ('V', '', 'V', 0), ('V', 'I', 'A', 3), ('V', 'II', 'U', 6), ('U', '', 'U', 0), ('U', 'I', 'A', 3), ('A', '', 'A', 0), ('A', 'I', 'U', 3)),
op(s, x, put, t, c) AS (VALUES ('O', 's', 'K', 'V', 0), ('O', 'u', 'K', 'A', 0), ('V', 'u', 'K', 'A', 0), ('U', 'u', 'K', 'A', 0), ('A', 'a', 'K', 'U', 0),
  ('O', '*', 'R', 'A', 3), ('V', '*', 'R', 'A', 3), ('U', '*', 'R', 'A', 3), ('A', '*', 'R', 'U', 3), ('O', '*', 'D', 'O', 4), ('V', '*', 'D', 'V', 4), ('U', '*', 'D', 'U', 4), ('A', '*', 'D', 'A', 4)),
p AS (
  SELECT conv_id, 0::BIGINT AS i, 'O' AS s, {{'c': 0::BIGINT, 'a': ''}} AS best FROM st
  UNION ALL
  SELECT p.conv_id, f.i, op.t, min({{'c': (p.best.c + ins.c + op.c + CASE WHEN op.put <> 'D' AND f.fault = 't' THEN 3 ELSE 0 END)::BIGINT, 'a': p.best.a || ins.put || op.put}})
  FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN ins ON ins.s = p.s JOIN op ON op.s = ins.t AND op.x IN ('*', f.x) AND (op.put = 'D' OR f.fault NOT IN ('b', 'd'))
  GROUP BY p.conv_id, f.i, op.t),
z AS (SELECT st.conv_id, min({{'c': (p.best.c + ins.c)::BIGINT, 'a': p.best.a || ins.put}}) AS best FROM st JOIN p ON st.conv_id IS NOT DISTINCT FROM p.conv_id AND st.n = p.i JOIN ins ON ins.s = p.s
  WHERE ins.t IN ('O', 'U') GROUP BY st.conv_id),
l AS (SELECT conv_id, unnest(string_split(best.a, '')) AS put, generate_subscripts(string_split(best.a, ''), 1) AS j, length(replace(best.a, 'D', '')) AS size FROM z WHERE best.a <> ''),
w AS (SELECT *, count(*) FILTER (put <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (put <> 'D') OVER (PARTITION BY conv_id ORDER BY j) - 1 AS place FROM l),
h AS (SELECT w.conv_id, string_agg(CASE WHEN put = 'K' THEN f.role WHEN (place + size) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN put = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY j) AS all_
  FROM w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i WHERE put <> 'D' GROUP BY w.conv_id)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(z.best.c, 0)::BIGINT AS cost, coalesce(z.best.a, '') AS audit, sha256(coalesce(all_, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN st ON q.conv_id IS NOT DISTINCT FROM st.conv_id LEFT JOIN z ON q.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN h ON q.conv_id IS NOT DISTINCT FROM h.conv_id
"""
