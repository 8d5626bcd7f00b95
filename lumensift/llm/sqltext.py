"""SQL twins (DuckDB) of the queries that SQL can express on whole tables."""

SQL: dict[str, str] = {}

SQL["op8_url_reputation"] = r"""
WITH p AS (
  SELECT page_id, url,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
r AS (SELECT * FROM (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'block'),
       ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')) t(rule, rhost, rpath, verdict)),
hit AS (
  SELECT page_id, url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, url),
lab AS (
  SELECT p.host, CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 1 WHEN l.toxic IS NOT NULL OR l.quality IS NOT NULL THEN 0 END AS bad
  FROM p JOIN labels l ON TRY_CAST(nullif(regexp_extract(p.path, '/([0-9]{1,18})(?:/|[.]html)?$', 1), '') AS BIGINT) = l.doc_id),
h AS (
  SELECT host, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM (SELECT host, 0 AS n, 0 AS k FROM p UNION ALL SELECT host, 1, bad FROM lab WHERE bad IS NOT NULL) GROUP BY host),
hh AS (
  SELECT host, n, k, list_aggregate(string_split(host, '.')[-1:], 'string_agg', '.') AS suffix, list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') AS domain FROM h),
g AS (SELECT (coalesce(sum(k), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS m FROM hh),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT m FROM g) AS m FROM hh GROUP BY suffix),
s1 AS (SELECT CASE WHEN sum(CASE WHEN n > 0 THEN m*(1-m)*(n-1) ELSE 0 END) > 0
   THEN greatest(0.001, least(0.5, sum(CASE WHEN n > 0 THEN n*pow(k/n - m, 2) - m*(1-m) ELSE 0 END) / sum(CASE WHEN n > 0 THEN m*(1-m)*(n-1) ELSE 0 END))) ELSE 0.5 END AS rho FROM s0),
s AS (SELECT suffix, (k + (1-rho)/rho*m) / ((k + (1-rho)/rho*m) + (n - k + (1-rho)/rho*(1-m))) AS m FROM s0, s1),
d0 AS (SELECT hh.suffix, domain, sum(n) AS n, sum(k) AS k, any_value(s.m) AS m FROM hh JOIN s ON hh.suffix = s.suffix GROUP BY hh.suffix, domain),
d1 AS (SELECT CASE WHEN sum(CASE WHEN n > 0 THEN m*(1-m)*(n-1) ELSE 0 END) > 0
   THEN greatest(0.001, least(0.5, sum(CASE WHEN n > 0 THEN n*pow(k/n - m, 2) - m*(1-m) ELSE 0 END) / sum(CASE WHEN n > 0 THEN m*(1-m)*(n-1) ELSE 0 END))) ELSE 0.5 END AS rho FROM d0),
d AS (SELECT domain, (k + (1-rho)/rho*m) / ((k + (1-rho)/rho*m) + (n - k + (1-rho)/rho*(1-m))) AS m FROM d0, d1),
e0 AS (SELECT host, n, k, d.m AS m FROM hh JOIN d ON hh.domain = d.domain),
e1 AS (SELECT CASE WHEN sum(CASE WHEN n > 0 THEN m*(1-m)*(n-1) ELSE 0 END) > 0
   THEN greatest(0.001, least(0.5, sum(CASE WHEN n > 0 THEN n*pow(k/n - m, 2) - m*(1-m) ELSE 0 END) / sum(CASE WHEN n > 0 THEN m*(1-m)*(n-1) ELSE 0 END))) ELSE 0.5 END AS rho FROM e0),
e AS (SELECT host, k + (1-rho)/rho*m AS a, n - k + (1-rho)/rho*(1-m) AS b FROM e0, e1)
SELECT p.page_id, p.url, p.host, p.path, hit.rule,
  coalesce(hit.verdict, CASE WHEN a/(a+b) - 1.6448536269514722 * sqrt(a*b / ((a+b)*(a+b)*(a+b+1))) > 0.25 THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN e ON p.host = e.host LEFT JOIN hit ON p.page_id = hit.page_id AND p.url = hit.url
"""

SQL["op1_exact_topk"] = """
WITH x AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings),
bad AS (SELECT DISTINCT vec_id FROM x WHERE e IS NULL OR NOT isfinite(e::DOUBLE)),
v AS (SELECT vec_id, i, floor(64 * e::DOUBLE)::BIGINT AS w FROM x WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 20
"""

SQL["op4_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM x),
f AS (SELECT g, min(doc_id) AS lo FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f ON g.g = f.g WHERE lo < doc_id),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT t.doc_id, count(c.p) AS n_removed, string_agg(CASE WHEN c.p IS NULL THEN word END, ' ' ORDER BY t.p) AS kept FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.p = c.p GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

SQL["op5_decontamination"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bi AS (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bi),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k),
h AS (SELECT doc_id, item, i, di.k FROM di JOIN iw ON di.k = iw.k AND array_to_string(w[i:i + di.k - 1], ' ') = g),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""


def _licences() -> str:
    from lumensift.llm.licenses import RULES, SENTENCES, rule_pattern

    known = ", ".join(f"('{s}', '{n}')" for n, s in SENTENCES.items())
    sequence = lambda name, text: f"""
{name} AS (SELECT doc_id, string_agg(id, ',' ORDER BY i) AS ids, count(*) AS n FROM (
  SELECT doc_id, id, i FROM (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace({text}, '[.!?;]+([ \\t\\r\\n]|$)', chr(10), 'g'), chr(10)) AS s FROM documents WHERE text IS NOT NULL)) u
  JOIN k ON trim(regexp_replace(translate(u.s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) = k.s) GROUP BY doc_id)"""  # noqa: E731
    names = list(dict.fromkeys(n for n, _, _ in RULES))
    holds = {n: " OR ".join(f"regexp_matches(x, '{p}') OR regexp_matches(y, '{p}')" for m, seq, _ in RULES if m == n for p in [rule_pattern(seq)]) for n in names}
    hidden = {n: [m for m, _, gone in RULES if n in gone] for n in names}
    shown = ", ".join(f"CASE WHEN ({holds[n]})" + "".join(f" AND NOT ({holds[m]})" for m in hidden[n]) + f" THEN '{n}' END" for n in names)
    return f"""
WITH k(s, id) AS (VALUES {known}),{sequence('a', 'text')},{sequence('b', "translate(text, chr(13) || chr(10), '  ')")},
j AS (SELECT d.doc_id, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb, coalesce(a.ids, '') AS ia, coalesce(b.ids, '') AS ib, ',' || coalesce(a.ids, '') || ',' AS x, ',' || coalesce(b.ids, '') || ',' AS y
  FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN b ON d.doc_id = b.doc_id)
SELECT doc_id, CASE WHEN na >= nb THEN ia ELSE ib END AS sentence_ids, concat_ws(',', {shown}) AS licenses, greatest(na, nb)::BIGINT AS n_known FROM j
"""


SQL["op6_license_scan"] = _licences()
