"""DuckDB SQL of the corpus queries that SQL can express, with constants of its own."""

from __future__ import annotations

#: Gaps and matches of a pattern: text is cut at the matches, so a match starts after all gaps and matches before it.
_SPANS = """{name}_h AS (SELECT row, regexp_extract_all(body, '{pattern}') AS hits, regexp_split_to_array(body, '{pattern}') AS gaps FROM d),
{name}_e AS (SELECT row, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(list_slice(gaps, 1, len(hits))) AS gap FROM {name}_h),
{name} AS (SELECT row, hit, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY row ORDER BY i) AS BIGINT) AS e FROM {name}_e)"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(name: str, pattern: str) -> str:
    return _SPANS.format(name=name, pattern=pattern)


SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents),
{_spans("assign", _ASSIGN)},
{_spans("access", "AKIA[A-Z0-9]{16,}")},
{_spans("hex", "[0-9a-f]{24,}")},
{_spans("run", "[A-Za-z0-9+/_=-]{20,}")},
base AS (SELECT row, e - length(hit) AS s, 0 AS k, e FROM assign WHERE length(regexp_extract(hit, '{_VALUE}', 1)) >= 6
  UNION ALL SELECT row, e - length(hit), 1, e FROM access UNION ALL SELECT row, e - length(hit), 2, e FROM hex),
loud AS (SELECT row, e - length(hit) AS s, e, hit,
    list_max(list_transform(range(1, length(hit) - 18), lambda i: list_aggregate(string_split(substr(hit, CAST(i AS BIGINT), 20), ''), 'entropy'))) AS bits FROM run
  WHERE NOT regexp_full_match(hit, '[A-Za-z+/_=-]+') AND NOT regexp_full_match(hit, '[0-9+/_=-]+')
    AND NOT regexp_full_match(hit, '[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}')
    AND NOT regexp_full_match(hit, '[A-Za-z]*[0-9]{{0,4}}([-_/=+]+[A-Za-z]*[0-9]{{0,4}})+')),
more AS (SELECT row, s, 3 AS k, e FROM loud m WHERE bits >= CASE WHEN regexp_full_match(hit, '[0-9a-fA-F]+') THEN 3.0
    WHEN regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]') THEN 3.8 ELSE 3.6 END
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = m.row AND b.s < m.e AND m.s < b.e)),
every AS (SELECT *, list_extract(['assign', 'access', 'hex', 'entropy'], k + 1) || ':' || s || ':' || e AS name FROM (SELECT * FROM base UNION ALL SELECT * FROM more)),
told AS (SELECT row, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2,
  string_agg(name, ',' ORDER BY s, k, e) FILTER (WHERE k < 3) AS own, string_agg(name, ',' ORDER BY s, k, e) AS spans FROM every GROUP BY row)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (row)"""

_STOP = "'the','and','of','to','in','is','that','it','for','de','la','el','que','en','los','las','y','un','una','le','les','des','et','est','une','der','die','das','und','den','ist','von','mit','zu'"

QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT row, i, words[i : i + 4] AS gram FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
hot AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS place FROM hot) GROUP BY row),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop, length(regexp_replace(body, '[^A-Z]', '', 'g')) AS n_capitals
  FROM w LEFT JOIN covered c USING (row)),
r AS (SELECT *, CASE WHEN n_words > 0 THEN n_repeat_words / n_words END AS repeat_ratio, CASE WHEN n_words > 0 THEN word_chars / n_words END AS mean_word,
  CASE WHEN n_words > 0 THEN n_symbols / n_words END AS symbol_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines END AS dup_line_ratio,
  CASE WHEN n_words >= 50 THEN n_stop / n_words END AS stop_ratio, CASE WHEN word_chars > 0 THEN n_capitals / word_chars END AS capital_ratio,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(repeat_ratio <= 0.2, true) AND coalesce(mean_word BETWEEN 1.5 AND 25.0, true) AND coalesce(symbol_ratio <= 0.4, true)
    AND coalesce(dup_line_ratio <= 0.5, true) AND coalesce(stop_ratio >= 0.005, true) AND coalesce(capital_ratio <= 0.6, true) AS kept,
  repeat_ratio, mean_word, symbol_ratio, dup_line_ratio, stop_ratio, capital_ratio FROM r"""

ORACLES = {"op4_secret_scan": SECRETS, "op5_quality_rules": QUALITY}
