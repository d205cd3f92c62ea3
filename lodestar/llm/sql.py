"""DuckDB SQL that states the results of queries, from the definitions and not from the operators' code.

Queries that rest on a tokenizer, a spectrum or a page's layout have none; tests hold them against plain versions.
"""

from __future__ import annotations

from lodestar.llm import quality, secrets

_WORD = r"[^\x20\x09-\x0D]+"

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY l[i:i+2] ORDER BY doc_id, i) AS k FROM w WHERE regexp_matches(array_to_string(l[i:i+2], ''), '[^\x20\x09-\x0D]')),
c AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM o, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1 GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN l ELSE list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)), lambda i: l[i]) END, chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w] ELSE list_transform(range(1, len(w)), lambda i: w[i:i+1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY a, b),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lower(regexp_extract(coalesce(source, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)', 1)) AS host FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
p AS (SELECT r, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS i FROM w WHERE len(ws) >= {quality.WINDOW}),
q AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i:i+{quality.WINDOW - 1}]) AS n FROM p),
x AS (SELECT r, count(DISTINCT i + j) AS n FROM q, (SELECT unnest(range({quality.WINDOW})) AS j) WHERE n > 1 GROUP BY r),
c AS (SELECT doc_id, host, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0) AS BIGINT) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(x.n, 0) AS n_repeat_words FROM w LEFT JOIN x USING (r)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM c),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS k FROM b GROUP BY host),
m AS (SELECT avg(k / n) AS m, CASE WHEN var_pop(k / n) > 1e-9 THEN greatest(1.0, least(1000.0, avg(k / n) * (1 - avg(k / n)) / var_pop(k / n) - 1)) ELSE 1000.0 END AS s FROM h),
v AS (SELECT host, (k + m * s) / (n + s) > {quality.MAX_HOST_RATE} AS host_rejected FROM h, m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected, NOT base_failed AND NOT host_rejected AS kept FROM b JOIN v USING (host)
"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS i, h FROM d WHERE length(h) >= 100),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS g FROM s),
m AS (SELECT g, min(doc_id) AS f FROM k GROUP BY g HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i FROM k JOIN m USING (g) WHERE doc_id > f),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 50 THEN 0 ELSE 1 END AS fresh FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM n GROUP BY doc_id, run),
e AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS gone, list({'a': a, 'z': z} ORDER BY a) AS l FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN l IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(l) + 1), lambda j:     substr(h, CASE WHEN j = 0 THEN 1 ELSE 2 * l[j].z + 1 END, CASE WHEN j = len(l) THEN length(h) ELSE 2 * l[j + 1].a END - CASE WHEN j = 0 THEN 0 ELSE 2 * l[j].z END)), '') END)) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id)
"""


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _matches(pattern: str, kind: int, where: str = "TRUE") -> str:
    p = _quoted(pattern)
    return f"""SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda k: {{'s': m[k], 'a': coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0)}}), recursive := true), {kind} AS kind
FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g FROM d) WHERE len(m) > 0 AND {where}"""


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_matches(secrets.ASSIGN, 0)} UNION ALL {_matches(secrets.ACCESS, 1)} UNION ALL {_matches(secrets.HEX, 2)}),
b AS (SELECT doc_id, kind, CAST(a AS BIGINT) AS a, CAST(a + length(s) AS BIGINT) AS z FROM f WHERE kind > 0 OR length(regexp_extract(s, '{_quoted(secrets.ASSIGN)}', 2)) >= 8),
c AS ({_matches(secrets.CANDIDATE, 3)}),
u AS (SELECT doc_id, s, a, unnest(range(0, length(s) - {secrets.WINDOW - 1})) AS i FROM c WHERE NOT regexp_matches(s, '{_quoted(secrets.ALLOWED)}')),
x AS (SELECT *, string_split(substr(s, i + 1, {secrets.WINDOW}), '') AS q FROM u),
y AS (SELECT doc_id, s, a, i FROM x WHERE list_sum(list_transform(list_distinct(q), lambda v: {secrets.CLOGC}[len(list_filter(q, lambda o: o = v)) + 1])) <= CASE WHEN regexp_full_match(s, '[0-9a-fA-F]+') THEN {secrets.MOST['hex']} ELSE {secrets.MOST['other']} END),
g AS (SELECT *, CASE WHEN i <= lag(i) OVER w + {secrets.WINDOW} THEN 0 ELSE 1 END AS fresh FROM y WINDOW w AS (PARTITION BY doc_id, a ORDER BY i)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, a ORDER BY i) AS run FROM g),
e AS (SELECT doc_id, 3 AS kind, CAST(a + min(i) AS BIGINT) AS a, CAST(a + max(i) + {secrets.WINDOW} AS BIGINT) AS z FROM r GROUP BY doc_id, a, run),
n AS (SELECT * FROM b UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = e.doc_id AND b.a < e.z AND e.a < b.z)),
l AS (SELECT doc_id, kind, a, z, {list(secrets.KINDS)}[kind + 1] || ':' || a || ':' || z AS v FROM n),
k AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(v, ',' ORDER BY a, kind, z) FILTER (kind < 3) AS base, string_agg(v, ',' ORDER BY a, kind, z) AS spans FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN k USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP,
    "op3_minhash_near_dedup": NEAR_DEDUP,
    "op5_quality_rules": QUALITY,
    "op7_suffix_dedup": REPEATS,
    "op9_secret_scans": SECRETS,
}
