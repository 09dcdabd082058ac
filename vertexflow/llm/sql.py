"""DuckDB SQL for the corpus queries that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+')"

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh, len(w) AS nw FROM w),
c AS MATERIALIZED (SELECT doc_id, list_sort(sh) AS sh, len(sh) AS n, least(nw, 3) AS kind FROM s),
g AS MATERIALIZED (SELECT min(doc_id) AS rep, sh, n, kind FROM c WHERE n > 0 GROUP BY sh, n, kind),
u AS MATERIALIZED (SELECT rep, n, unnest(sh) || ':' || kind AS t FROM g),
p AS (SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS m
  FROM u a JOIN u b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * m >= 85 * (na + nb - m)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT rep, rep FROM g UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT x, min(y) AS root FROM r GROUP BY x)
SELECT c.doc_id, c.n AS n_shingles, coalesce(k.root, c.doc_id) AS component_id, c.doc_id = coalesce(k.root, c.doc_id) AS kept
FROM c LEFT JOIN g ON c.sh = g.sh AND c.kind = g.kind LEFT JOIN k ON k.x = g.rep
"""

OP5 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS n_tokens, md5('0:' || doc_id) AS h FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS t FROM d GROUP BY source),
x AS (SELECT max(t)::DOUBLE / min(t) AS spread, sum(t)::DOUBLE AS total FROM s),
a AS (SELECT CASE WHEN spread <= 2 THEN 0.0 ELSE 1 - ln(2) / ln(spread) END AS e, total FROM x),
w AS (SELECT source, t, pow(t / total, e) / sum(pow(t / total, e)) OVER () AS w FROM s, a),
b AS (SELECT source, t, w, round(w * max(t / w) OVER (), 3) AS quota FROM w),
q AS (SELECT source, w, floor(quota / t)::BIGINT AS passes, round(quota - floor(quota / t) * t, 3) AS rest FROM b),
r AS (SELECT d.*, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, r.source, n_tokens, round(w, 9) AS weight, passes + (start < rest)::BIGINT AS copies FROM r JOIN q USING (source)
"""

OP6 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP7 = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT page_id, path, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM p),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, arg_max(rh || rp, length(rh) * 1000 + length(rp)) AS rule, arg_max(verdict, length(rh) * 1000 + length(rp)) AS verdict
  FROM k JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM k LEFT JOIN m USING (page_id)
"""

ORACLES: dict[str, str] = {
    "op2_near_dedup": OP2,
    "op5_mix_sources": OP5,
    "op6_exact_dedup": OP6,
    "op7_url_filter": OP7,
}
