"""DuckDB SQL for the operators that SQL can express."""

from nearfield.llm.url_filter import SOFT, STRICT, Vocabulary


def _boundary(term: str) -> str:
    return f"regexp_matches(coalesce(u, ''), '(^|[^\\p{{L}}\\p{{N}}]){term}([^\\p{{L}}\\p{{N}}]|$)')"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_strict = " OR ".join(_boundary(t) for t in STRICT)
_soft = " + ".join(f"CASE WHEN {_boundary(t)} THEN {w} ELSE 0 END" for t, w in SOFT.items())

OP10 = f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, translate(url_decode(url), '{_UPPER}', '{_LOWER}') AS u FROM pages),
     r AS (SELECT *, CASE
              WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
              {_strict} AS strict, {_soft} AS soft,
              {" + ".join(f"CASE WHEN {_boundary(t)} THEN 1 ELSE 0 END" for t in SOFT)} AS n_soft,
              {" + ".join(f"CASE WHEN {_boundary(t)} THEN 1 ELSE 0 END" for t in STRICT)} AS n_strict FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN strict OR (n_soft >= {Vocabulary().several} AND soft >= {Vocabulary().min_soft}) THEN 'block' ELSE 'allow' END AS verdict,
       CAST(n_strict AS BIGINT) AS n_strict, CAST(n_soft AS BIGINT) AS n_soft, CAST(soft AS BIGINT) AS soft_weight FROM r
"""

_KINDS = (
    ("assign", 0, r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", 2, r"[0-9a-f]+", 0, 32),
)


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Matches with their place: a match ends after all gaps and matches up to it."""
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, total - len AS start, total AS stop FROM (
  SELECT doc_id, len, glen, sum(gap + len) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM (
    SELECT doc_id, i, length(m[i]) AS len, length(g[i]) AS glen, length(s[i]) AS gap FROM (
      SELECT doc_id, m, g, s, unnest(generate_series(1, len(m))) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, regexp_split_to_array(t, '{pattern}') AS s FROM d)))) WHERE glen >= {least}"""


OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     f AS ({" UNION ALL ".join(_spans(*k) for k in _KINDS)}),
     a AS (SELECT doc_id, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans,
                  count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


def _escaped(column: str) -> str:
    return f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


OP7 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
     w AS (SELECT *, row_number() OVER o AS i, lag(role) OVER o IS NOT DISTINCT FROM role AS same FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
     x AS (SELECT *, length({_escaped("text")}) + CASE WHEN same THEN length('<next>') ELSE length('<turn:' || {_escaped("role")} || '>') + length('</turn>') END AS n FROM w)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""

ORACLES = {"op6_blob_ledger": OP6, "op7_chat_formatting": OP7, "op10_url_vocabulary": OP10}
