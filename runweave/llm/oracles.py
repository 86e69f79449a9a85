"""SQL for the queries that SQL expresses, with no shortcut the query itself takes.

None is given for packing (a tokenizer), votes and toxicity (fitted models) and
personal data (patterns with look-behind); those are tested by brute force.
"""

from __future__ import annotations

from .queries import URL_RULES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

_OP1 = """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a),
comp AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON id = vec_id LEFT JOIN n ON a = vec_id
"""

_OP2 = f"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS.format('text')})::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS after FROM s1),
s3 AS (SELECT *, ((SELECT sum(source_size) FROM s1)::BIGINT - before)::DOUBLE / after AS level FROM s2),
s4 AS (SELECT *, (SELECT arg_min(level, cap::DOUBLE / w) FROM s3 WHERE level <= cap::DOUBLE / w) AS lv FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN cap::DOUBLE / w < lv THEN cap::DOUBLE ELSE lv * w END AS target FROM s4),
s6 AS (SELECT *, least(3, floor(target / greatest(source_size, 1)))::BIGINT AS times FROM s5),
s7 AS (SELECT *, target - times * source_size AS rest FROM s6),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto,
  sum(size) OVER (PARTITION BY source, h)::BIGINT AS own FROM d)
SELECT doc_id, c.source, size, source_size, target, least(size * (times + (upto - own + own::DOUBLE / 2 <= rest)::BIGINT), 3 * size)::BIGINT AS taken
FROM c JOIN s7 ON c.source IS NOT DISTINCT FROM s7.source
"""

_OP4 = r"""
WITH p AS (
  SELECT page_id, page_id * 60 AS began, regexp_replace(url, '#.*$', '') AS u, CASE WHEN page_id % 3 <> 0 THEN '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' END AS etag,
    'm' || (page_id % 5) AS modified, sha1(coalesce(html, '')) AS sha FROM pages),
h AS (SELECT *, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) AS head FROM p),
k AS (SELECT page_id, began, etag, modified, sha, CASE WHEN head = '' THEN u ELSE regexp_replace(regexp_replace(head, '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1')
  || CASE WHEN starts_with(substr(u, length(head) + 1), '/') THEN substr(u, length(head) + 1) ELSE '/' || substr(u, length(head) + 1) END END AS url_key FROM h),
r AS (SELECT page_id, url_key, began + 1800 AS again, CASE WHEN page_id % 7 = 0 THEN '"other"' ELSE etag END AS etag, CASE WHEN page_id % 7 = 0 THEN 'other' ELSE modified END AS modified FROM k),
j AS (
  SELECT a.*, b.page_id AS found, b.began AS first, b.etag AS e, b.modified AS m, b.sha, row_number() OVER (PARTITION BY a.page_id ORDER BY b.began DESC NULLS LAST, b.page_id DESC) AS rn
  FROM r a LEFT JOIN k b ON a.url_key = b.url_key AND b.page_id % 11 <> 0 AND (b.began < a.again OR b.began = a.again AND b.page_id * 2 < a.page_id * 2 + 1)),
o AS (SELECT *, found IS NOT NULL AND CASE WHEN e IS NOT NULL AND etag IS NOT NULL THEN e = etag ELSE coalesce(m = modified, false) END AS ok, coalesce(etag, e) AS tag FROM j WHERE rn = 1)
SELECT page_id * 2 + 1 AS record_id, url_key, CASE WHEN found IS NULL THEN 'missing' WHEN ok THEN 'resolved' ELSE 'mismatch' END AS outcome,
  CASE WHEN ok THEN found * 2 END AS resolved_id,
  CASE WHEN ok THEN 'content-type: text/html' || chr(10) || 'date: ' || again || CASE WHEN tag IS NULL THEN '' ELSE chr(10) || 'etag: ' || tag END || chr(10) || 'server: a' END AS headers,
  CASE WHEN ok THEN sha END AS digest
FROM o
"""

_OP6 = f"""
WITH rules(rh, rp, rv) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
m AS (SELECT h.*, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS rn
  FROM h LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE rn = 1
"""

_OP8 = """
WITH c AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn, role, text) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT DISTINCT conv_id // 2 AS pair_id FROM c),
p AS (SELECT pair_id, pair_id * 2 AS chosen_id, pair_id * 2 + 1 AS rejected_id, coalesce(a.t, []) AS c, coalesce(b.t, []) AS r
  FROM k LEFT JOIN c a ON a.conv_id = pair_id * 2 LEFT JOIN c b ON b.conv_id = pair_id * 2 + 1),
n AS (SELECT *, coalesce([i - 1 FOR i IN range(1, least(len(c), len(r)) + 1) IF c[i].role <> r[i].role OR c[i].text <> r[i].text][1], least(len(c), len(r)))::INTEGER AS n_prompt FROM p),
s AS (SELECT *, c[1:n_prompt] AS head, c[n_prompt + 1:] AS ct, r[n_prompt + 1:] AS rt FROM n),
x AS (SELECT *,
  ['<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) FOR t IN head] AS hs,
  ['<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) FOR t IN ct] AS cs,
  ['<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) FOR t IN rt] AS rs FROM s)
SELECT pair_id, chosen_id, rejected_id, n_prompt, coalesce(array_to_string(hs, ''), '') AS prompt, coalesce(array_to_string(cs, ''), '') AS chosen, coalesce(array_to_string(rs, ''), '') AS rejected,
  coalesce(array_to_string([(length(array_to_string(cs[1:i], '')) - length(ct[i].text) - 8)::VARCHAR || '-' || length(array_to_string(cs[1:i], ''))::VARCHAR FOR i IN range(1, len(ct) + 1) IF ct[i].role = 'assistant'], ','), '') AS chosen_mask,
  coalesce(array_to_string([(length(array_to_string(rs[1:i], '')) - length(rt[i].text) - 8)::VARCHAR || '-' || length(array_to_string(rs[1:i], ''))::VARCHAR FOR i IN range(1, len(rt) + 1) IF rt[i].role = 'assistant'], ','), '') AS rejected_mask,
  len([1 FOR t IN ct IF t.role = 'assistant']) > 0 AND len([1 FOR t IN rt IF t.role = 'assistant']) > 0 AS usable
FROM x
"""

_OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(text, '{_UP}', '{_LOW}')")} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a),
comp AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d JOIN comp ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_vector_neardup": _OP1,
        "op2_mix_sources": _OP2,
        "op4_warc_revisits": _OP4,
        "op6_url_rules": _OP6,
        "op8_preference_format": _OP8,
        "op9_jaccard_join": _OP9,
    }
