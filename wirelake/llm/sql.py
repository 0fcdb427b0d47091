"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from wirelake.llm.license_scan import LEAST, SHINGLE, TEMPLATES, stride, template_words, window_class
from wirelake.llm.secret_scan import RULES as SECRETS
from wirelake.llm.url_filter import RULES

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

URLS = f"""
WITH rules(verdict, host, path) AS (VALUES {_RULES}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut)
SELECT p.page_id, p.host, p.path,
  (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule,
  coalesce((SELECT arg_max(r.verdict, length(r.host || r.path)) FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)), 'allow') AS verdict
FROM parts p
"""

CONTAMINATION = rf"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
places AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes)),
found AS (SELECT r, i, p.size, item_id FROM places p JOIN windows USING (size, win)),
hit AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit h USING (r) LEFT JOIN items t USING (r)
"""



def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_KINDS = "\n  UNION ALL ".join(
    f"SELECT r, {k} AS rank, {_quoted(s.kind)} AS kind, {str(s.base).lower()} AS base, regexp_extract_all(t, {_quoted(s.pattern)}) AS m, string_split_regex(t, {_quoted(s.pattern)}) AS g,"
    f" list_transform(regexp_extract_all(t, {_quoted(s.pattern)}, {s.group}), lambda x: length(x) >= {s.least}) AS ok FROM docs"
    for k, s in enumerate(SECRETS)
)
_COUNTS = ", ".join(f"count(*) FILTER (kind = '{s.kind}') AS n_{s.kind}" for s in SECRETS if s.base)
_LONGS = ", ".join(f"coalesce(n_{s.kind}, 0)::BIGINT AS n_{s.kind}" for s in SECRETS if s.base)

SPANS = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({_KINDS}),
each_match AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw),
placed AS (
  SELECT r, rank, kind, base, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS b, length(m[i]) AS n
  FROM each_match WHERE ok[i]),
spans AS (SELECT *, kind || ':' || b::BIGINT || ':' || (b + n)::BIGINT AS s FROM placed),
agg AS (SELECT r, {_COUNTS}, string_agg(s, ',' ORDER BY b, rank) AS spans, string_agg(s, ',' ORDER BY b, rank) FILTER (base) AS own FROM spans GROUP BY r)
SELECT doc_id, {_LONGS}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN agg USING (r)
"""

def _template(name: str, text: str) -> str:
    w = template_words(text)
    run = min(SHINGLE, len(w))
    size = window_class(len(w))
    grams = sorted({" ".join(w[i : i + run]) for i in range(len(w) - run + 1)})
    return ",\n  ".join(f"('{name}', {run}, {size - run + 1}, {stride(size)}, {len(grams)}, '{g}')" for g in grams)


_TEMPLATES = ",\n  ".join(_template(k, v) for k, v in TEMPLATES.items())

#: Without MinHash: every window is held against every template with which it shares a shingle.
LICENSES = f"""
WITH grams(license, run, span, step, n, gram) AS (VALUES {_TEMPLATES}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+'), []) AS w FROM documents),
runs AS (SELECT DISTINCT run FROM grams),
places AS (SELECT r, run, i, array_to_string(w[i:i + run - 1], ' ') AS gram FROM (SELECT r, w, run, unnest(range(1, greatest(len(w) - run + 1, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM docs, runs)),
hits AS (SELECT r, i, license, span, step, n, gram FROM places JOIN grams USING (run, gram)),
windows AS (SELECT DISTINCT r, license, span, step, n, k FROM (SELECT *, unnest(range((greatest(i - span - 2 * step, 0) // step), (i + step) // step + 1)) AS k FROM hits)),
scores AS (
  SELECT h.r, h.license, k, count(DISTINCT gram) / max(h.n) AS score FROM windows v JOIN hits h USING (r, license)
  WHERE h.i >= greatest(1 + k * h.step - h.step, 1) AND h.i < 1 + k * h.step + h.span + h.step GROUP BY ALL),
best AS (SELECT r, license, max(score) AS score FROM scores WHERE score >= {LEAST} GROUP BY ALL),
agg AS (SELECT r, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names, max(score) AS score FROM best GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses, coalesce(score, 0.0)::DOUBLE AS score FROM docs LEFT JOIN agg USING (r)
"""

NEAR = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common JOIN sizes x ON u = x.doc_id JOIN sizes y ON v = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM docs UNION SELECT reach.doc_id, e.v FROM reach JOIN edges e ON reach.r = e.u)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""

TOP = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (SELECT vec_id, min(v) AS v FROM rows WHERE vec_id % 50 = 0 GROUP BY vec_id),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM asked q JOIN rows c ON q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLE = {"op5_topk": TOP, "op7_near_dedup": NEAR, "op10_license_scan": LICENSES, "op3_secret_scan": SPANS, "op8_url_filter": URLS, "op9_decontamination": CONTAMINATION}
