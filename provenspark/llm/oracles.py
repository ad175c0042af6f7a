"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS n, sha1(payload) AS s FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY s, n) AS first_id FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""

_LEVEL = """
{name}_m AS (
  SELECT greatest(2.0, least(1000.0, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 1000.0 END)) AS m FROM (
    SELECT CASE WHEN sum(n * up * (1 - up)) > sum(up * (1 - up))
                THEN greatest(0.0, (sum(n * (k / n - up) * (k / n - up)) - sum(up * (1 - up))) / (sum(n * up * (1 - up)) - sum(up * (1 - up))))
                ELSE 0.0 END AS rho
    FROM {name}_up)
)"""

OP6 = (
    r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
hosts AS (
  SELECT host, count(*)::DOUBLE AS n, sum(1 - quality)::DOUBLE AS k,
         array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, list_extract(string_split(host, '.'), -1) AS suffix
  FROM u JOIN labels l ON try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') AS BIGINT) = l.doc_id
  WHERE quality IS NOT NULL GROUP BY host
),
total AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS up FROM hosts),
suffix_up AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(up) AS up FROM hosts, total GROUP BY suffix),"""
    + _LEVEL.format(name="suffix")
    + """,
suffixes AS (SELECT suffix, (m * up + k) / (m + n) AS up FROM suffix_up, suffix_m),
domain_up AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(up) AS up FROM hosts JOIN suffixes USING (suffix) GROUP BY domain),"""
    + _LEVEL.format(name="domain")
    + """,
domains AS (SELECT domain, (m * up + k) / (m + n) AS up FROM domain_up, domain_m),
host_up AS (SELECT host, n, k, up FROM hosts JOIN domains USING (domain)),"""
    + _LEVEL.format(name="host")
    + """,
ab AS (SELECT host, m * up + k AS a, m * (1 - up) + n - k AS b FROM host_up, host_m),
bounds AS (SELECT host, a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab),
rules(action, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
  FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT u.page_id, u.host, u.path, best.rule,
       coalesce(best.action, CASE WHEN bound > 0.2 THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (page_id) LEFT JOIN bounds USING (host)
"""
)


def _matches(kind: str, rank: int, pattern: str, keep: str = "true") -> str:
    """Rows (doc_id, kind, rank, s, e, hit) of one pattern."""
    p = pattern.replace("'", "''")
    return f"""
{kind}_h AS (SELECT doc_id, string_split_regex(t, '{p}') AS pieces, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {1 if kind == "assign" else 0}) AS vals FROM docs WHERE regexp_matches(t, '{p}')),
{kind}_p AS (SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{'v': vals[i], 'hit': hits[i], 's': list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0)}})) AS x FROM {kind}_h),
{kind} AS (SELECT doc_id, '{kind}' AS kind, {rank} AS rank, x.s::BIGINT AS s, (x.s + length(x.hit))::BIGINT AS e, x.hit AS hit FROM {kind}_p WHERE {keep})"""


def op8() -> str:
    from provenspark.llm import secret_scan as s

    allow = " OR ".join("regexp_matches(hit, '" + p.replace("'", "''") + "')" for p in s.ALLOW)
    return (
        "WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),"
        + _matches("assign", 0, s.ASSIGN, f"length(x.v) >= {s.ASSIGN_VALUE}")
        + ","
        + _matches("access", 1, s.ACCESS)
        + ","
        + _matches("hex", 2, s.HEX)
        + ","
        + _matches("candidate", 3, s.CANDIDATE)
        + f""",
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
doubtful AS (
  SELECT c.*, CASE WHEN regexp_matches(hit, '^([0-9a-f]+|[0-9A-F]+)$') THEN {s.BITS["hex"]} WHEN regexp_matches(hit, '^[A-Za-z0-9]+$') THEN {s.BITS["alnum"]} ELSE {s.BITS["symbol"]} END AS bits
  FROM candidate c
  WHERE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT ({allow})
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id IS NOT DISTINCT FROM c.doc_id AND b.s <= c.s AND b.e >= c.e)
),
hot AS (
  SELECT doc_id, s, list_filter(range(0, length(hit) - {s.WINDOW} + 1), lambda i: list_entropy(string_split(substr(hit, (i + 1)::BIGINT, {s.WINDOW}), '')) >= bits) AS w FROM doubtful
),
spans AS (
  SELECT doc_id, kind, rank, s, e FROM base
  UNION ALL SELECT doc_id, 'entropy', 3, s + w[1], s + w[-1] + {s.WINDOW} FROM hot WHERE len(w) > 0
),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (kind <> 'entropy') AS b,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS every
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs LEFT JOIN joined USING (doc_id)
"""
    )


OP10 = (
    f"WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),"
    + """
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
least AS (SELECT x AS doc_id, min(least(x, y)) AS c FROM reach GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.c, doc_id) AS component_id, doc_id = coalesce(least.c, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4, "op6_url_filter": OP6, "op8_secret_scan": op8(), "op10_near_dedup": OP10}
