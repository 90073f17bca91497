"""DuckDB SQL for the driver's comparison: what each query means, written over the same tables."""

from __future__ import annotations

from termweave.constants import BACKGROUND_WORDS, DOMAIN_HINTS, GENERIC_SURFACES
from termweave.plans.fixtures import INJECTED


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _frags(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^A-Za-z0-9]+'), lambda x: x <> '')"


def _round4(e: str) -> str:
    return f"floor(({e}) * 10000 + 0.5) / 10000"


def _singular(x: str) -> str:
    return f"CASE WHEN {x} LIKE '%ies' AND length({x}) > 4 THEN left({x}, length({x}) - 3) || 'y' WHEN {x} LIKE '%s' AND {x} NOT LIKE '%ss' AND length({x}) > 3 THEN left({x}, length({x}) - 1) ELSE {x} END"


CATALOG = """
names AS (SELECT DISTINCT p_name AS canonical FROM part),
term AS (
  SELECT 'part.' || replace(canonical, ' ', '_') AS term_id, canonical, split_part(canonical, ' ', 1) AS adj, split_part(canonical, ' ', 2) AS noun,
    split_part(canonical, ' ', 1) = 'old' AS deprecated FROM names),
surface AS (
  SELECT term_id, canonical AS surface, 'canonical' AS kind, adj AS scopes, deprecated, unnest([canonical, adj || noun, adj || '_' || noun, adj || '-' || noun]) AS search_surface FROM term
  UNION ALL SELECT term_id, noun, 'alias', adj, false, noun FROM term)
"""

TEXTS = """
lines AS (
  SELECT DISTINCT (l_orderkey * 1000000 + l_partkey) * 10 + l_linenumber AS text_id, p_name, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun
  FROM lineitem JOIN part ON l_partkey = p_partkey),
texts AS (
  SELECT *, CASE text_id % 7 WHEN 0 THEN 'please update the ' || p_name || ' stock' WHEN 1 THEN 'set ' || adj || upper(left(noun, 1)) || substr(noun, 2) || '(now)'
    WHEN 2 THEN 'x = ' || adj || '_' || noun || ';' WHEN 3 THEN 'use ' || adj || '-' || noun WHEN 4 THEN p_name || 'ry parts'
    WHEN 5 THEN 'order more ' || noun || ' units' ELSE p_name || ' and ' || upper(p_name) END AS text FROM lines)
"""


def _matching(source: str = "texts", key: str = "text_id") -> str:
    """All occurrences, by runs of whole segments."""
    return f"""
segs AS (SELECT DISTINCT {key} AS text_id, text, regexp_extract_all(lower(text), '[a-z0-9_]+|[^a-z0-9_]') AS s FROM {source}),
spots AS (SELECT text_id, text, s, unnest(range(1, len(s) + 1)) AS pos FROM segs),
grams AS (SELECT text_id, text, s, pos, k, array_to_string(s[pos:pos + k - 1], '') AS g FROM spots, (VALUES (1), (3)) n(k) WHERE pos + k - 1 <= len(s)),
hits AS (
  SELECT text_id, term_id, surface, kind, scopes, deprecated, length(array_to_string(s[1:pos - 1], '')) AS "start", length(array_to_string(s[1:pos - 1], '')) + length(g) AS "end",
    substr(text, length(array_to_string(s[1:pos - 1], '')) + 1, length(g)) AS matched_text
  FROM grams JOIN surface ON g = search_surface)
"""


# in these texts an overlap is always an alias inside a longer canonical match
LONG = """
kept AS (
  SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.text_id = h.text_id AND o."start" < h."end" AND h."start" < o."end" AND o."end" - o."start" > h."end" - h."start"))
"""
ONE = """
one AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_id, "start", "end" ORDER BY term_id, surface) AS r FROM kept) WHERE r = 1)
"""
BY_TERM = """
by_term AS (
  SELECT text_id, term_id, count(*) AS match_count, (sum("end" - "start") + 10 * count(*) FILTER (kind = 'canonical'))::DOUBLE AS score,
    array_to_string(list(DISTINCT matched_text ORDER BY matched_text), ',') AS matched, min(scopes) AS scopes, bool_or(deprecated) AS dep FROM kept GROUP BY text_id, term_id),
by_text AS (SELECT text_id, count(*) AS n_terms, string_agg(term_id, ',' ORDER BY term_id) AS term_ids, min(term_id) AS only_id FROM by_term GROUP BY text_id),
resolved AS (
  SELECT t.text_id, coalesce(n_terms, 0)::INTEGER AS n_terms, CASE WHEN n_terms IS NULL THEN 'unknown' WHEN n_terms = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
    CASE WHEN n_terms IS NULL THEN 'no_match' WHEN n_terms = 1 THEN 'use_terms' ELSE 'ask_clarification' END AS action, coalesce(term_ids, '') AS term_ids, CASE WHEN n_terms = 1 THEN only_id END AS primary_term_id
  FROM texts t LEFT JOIN by_text USING (text_id))
"""
MATCH_COLUMNS = 'text_id, term_id, surface, matched_text, "start", "end", kind'
BASE = f"WITH {CATALOG}, {TEXTS}, {_matching()}, {LONG}"
SCOPED = f"WITH {CATALOG}, {TEXTS}, {_matching()}".replace("FROM grams JOIN surface ON g = search_surface", "FROM grams JOIN surface ON g = search_surface JOIN texts q USING (text_id) WHERE scopes = q.adj").replace("substr(text,", "substr(grams.text,")

ORACLE: dict[str, str] = {}
ORACLE["resolve_texts"] = f"{BASE}, {BY_TERM} SELECT text_id, status, action, n_terms, term_ids, primary_term_id FROM resolved"
ORACLE["resolve_scoped"] = f"{SCOPED}, {LONG}, {BY_TERM} SELECT text_id, status, action, n_terms, primary_term_id FROM resolved"
ORACLE["match_all"] = f"{BASE} SELECT {MATCH_COLUMNS} FROM hits"
ORACLE["match_scoped"] = f"{BASE} SELECT {MATCH_COLUMNS} FROM hits WHERE scopes IN ('blue', 'red')"
ORACLE["match_active_only"] = f"{BASE} SELECT {MATCH_COLUMNS} FROM hits WHERE NOT deprecated"
ORACLE["match_longest"] = f"{BASE}, {ONE} SELECT {MATCH_COLUMNS} FROM one"
ORACLE["surface_dimension"] = f"WITH {CATALOG} SELECT term_id, surface, kind, scopes, deprecated, search_surface FROM surface"
ORACLE["resolve_candidates"] = f"""{BASE}, {BY_TERM}, seen AS (
  SELECT text_id, term_id, array_to_string(list(matched_text ORDER BY f), ',') AS matched FROM (SELECT text_id, term_id, matched_text, min("start") AS f FROM kept GROUP BY ALL) GROUP BY text_id, term_id)
SELECT text_id, b.term_id, match_count::INTEGER AS match_count, score, s.matched, b.scopes, (dep OR t.deprecated) AS deprecated FROM by_term b JOIN seen s USING (text_id, term_id) JOIN term t ON t.term_id = b.term_id"""

IDENT = "SELECT p_partkey, replace(p_name, ' ', '_') || 'HTTPServers' || p_size AS ident FROM part"
ORACLE["surface_fragments"] = f"""WITH i AS ({IDENT}), f AS (SELECT *, {_frags('ident')} AS f FROM i)
SELECT p_partkey, array_to_string(f, ' ') AS fragments, array_to_string(f, ' ') AS normalized, array_to_string(list_transform(f, lambda x: {_singular('x')}), ' ') AS cluster_key, 'snake' AS shape, 'identifier' AS kind,
  array_to_string(list_filter(regexp_split_to_array(lower(ident), '[^a-z0-9]+'), lambda x: x <> ''), '_') AS term_id, replace(ident, '_', ' ') AS name FROM f"""
ORACLE["code_variants"] = """WITH n AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), c AS (SELECT *, upper(left(a, 1)) || substr(a, 2) AS ca, upper(left(b, 1)) || substr(b, 2) AS cb FROM n)
SELECT p_partkey, array_to_string([a || cb, ca || cb, a || '_' || b, upper(a || '_' || b), a || '-' || b], ',') AS variants FROM c"""
ORACLE["unicode_normalize"] = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN ' ' || p_name ELSE p_name || 'x' END AS norm, true AS changed, p_partkey % 3 = 2 AS has_bidi,
  (CASE p_partkey % 3 WHEN 0 THEN length(replace(p_name, ' ', '')) WHEN 1 THEN 1 + length(p_name) - length(replace(p_name, ' ', '')) ELSE 1 END)::INTEGER AS n_findings FROM part"""
ORACLE["guard_calls"] = f"""{BASE}, {BY_TERM}, calls AS (SELECT text_id, text_id % 50 = 0 AS hidden, CASE WHEN text_id % 2 = 0 THEN 'catalog.update_' || noun ELSE 'catalog.delete' END AS tool_name FROM texts),
judged AS (SELECT c.text_id, tool_name, hidden, CASE WHEN hidden THEN 'blocked' WHEN status = 'unknown' THEN 'no_match' WHEN status = 'ambiguous' THEN 'needs_clarification' WHEN tool_name LIKE 'catalog.update_%' THEN 'allowed' ELSE 'blocked' END AS status FROM calls c JOIN resolved USING (text_id))
SELECT text_id, tool_name, status, CASE status WHEN 'blocked' THEN 'block' WHEN 'needs_clarification' THEN 'ask_clarification' ELSE 'proceed' END AS action, status IN ('allowed', 'no_match') AS is_allowed, hidden AS unicode_blocked FROM judged"""
ORACLE["behavior_metrics"] = f"""WITH {CATALOG}, c AS (SELECT count(*) AS n, count(*) FILTER (length(canonical) % 5 = 0) AS odd FROM term), m AS (
  SELECT unnest(['resolution_status', 'resolution_action', 'canonicalization', 'ambiguity_detection', 'tool_status', 'tool_action', 'tool_allowed', 'wrong_tool_prevention', 'overall']) AS metric,
    unnest([n - odd, 0, n, 0, 0, 0, 2 * n, n, 5 * n - odd]) AS passed, unnest([n, 0, n, odd, 0, 0, 2 * n, n, 5 * n]) AS total FROM c)
SELECT metric, passed, total, CASE WHEN total > 0 THEN passed / total ELSE -1.0 END AS ratio FROM m"""

# In DuckDB's engine there is no look-around: every other character is doubled, so that names can take one on each side.
SEP = "[._:/-]"
SCOUT = f"""
WITH {CATALOG}, known AS (SELECT DISTINCT lower(x) AS key FROM (SELECT canonical AS x FROM term UNION ALL SELECT noun FROM term)),
rows AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
doubled AS (SELECT doc_id, line, t, regexp_replace(t, '([^A-Za-z0-9_])', '\\1\\1', 'g') AS d FROM rows),
named AS (
  SELECT doc_id, line, i AS spot, 1 AS src, x FROM (
    SELECT doc_id, line, unnest(m) AS x, unnest(range(len(m))) AS i FROM (
      SELECT doc_id, line, regexp_extract_all(d, '(?:^|[^A-Za-z0-9_])([A-Za-z][A-Za-z0-9]*(?:(?:\\.\\.|_|::|//|--)[A-Za-z0-9]+)+|[A-Za-z]+_[A-Za-z0-9_]+|[A-Z][A-Z0-9]{{2,}}|[A-Za-z]+[A-Z][A-Za-z0-9]*)(?:$|[^A-Za-z0-9_])', 1) AS m FROM doubled))),
cleaned AS (SELECT doc_id, line, src, spot, trim(replace(replace(replace(replace(x, '..', '.'), '::', ':'), '//', '/'), '--', '-'), '''".,;:()[]{{}}') AS surface FROM named),
ws AS (SELECT doc_id, line, regexp_extract_all(t, '[A-Za-z][A-Za-z0-9]+(?:''[A-Za-z0-9]+)?') AS w FROM rows),
runs AS (
  SELECT doc_id, line, n, i, list_transform(w[i:i + n - 1], lambda x: lower(x)) AS p FROM (SELECT doc_id, line, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM ws, (VALUES (2), (3)) v(n) WHERE len(w) >= n)),
judged AS (SELECT *, len(list_filter(p, lambda x: x IN {_in(BACKGROUND_WORDS)})) AS common FROM runs WHERE len(list_filter(p, lambda x: length(x) < 3)) = 0),
said AS (
  SELECT doc_id, line, 5 - n AS src, i - 1 AS spot, array_to_string(p, ' ') AS surface FROM judged
  WHERE p[1] NOT IN {_in(BACKGROUND_WORDS)} AND p[-1] NOT IN {_in(BACKGROUND_WORDS)} AND common < n
    AND (len(list_filter(p, lambda x: x IN {_in(DOMAIN_HINTS)})) > 0 OR (common <= 1 AND len(list_filter(p, lambda x: length(x) >= 7)) > 0))),
every AS (
  SELECT doc_id, line, src, spot, surface, CASE WHEN src > 1 THEN 'phrase' WHEN regexp_full_match(surface, '[A-Z][A-Z0-9]{{2,}}') THEN 'acronym' WHEN regexp_matches(surface, '{SEP}|_') OR regexp_matches(surface, '[a-z][A-Z]') THEN 'identifier' ELSE 'code' END AS kind
  FROM (SELECT * FROM cleaned WHERE surface <> '' AND surface NOT LIKE 'http://%' AND surface NOT LIKE 'https://%' UNION ALL SELECT * FROM said)),
keyed AS (SELECT *, lower(surface) AS key, list_filter(regexp_split_to_array(lower(surface), '[^a-z0-9]+'), lambda x: x <> '') AS tok FROM every),
usable AS (
  SELECT * FROM keyed WHERE length(surface) BETWEEN 3 AND 80 AND key NOT IN {_in(BACKGROUND_WORDS)} AND len(tok) BETWEEN 1 AND 6 AND NOT (len(tok) = 1 AND tok[1] IN {_in(BACKGROUND_WORDS)}) AND key NOT IN (SELECT key FROM known)),
once AS (SELECT doc_id, line, key, first(surface ORDER BY src, spot) AS surface, first(kind ORDER BY src, spot) AS kind FROM usable GROUP BY doc_id, line, key),
counted AS (
  SELECT key, first(surface ORDER BY doc_id, line) AS surface, first(kind ORDER BY doc_id, line) AS kind, count(*) AS occurrence_count, count(DISTINCT doc_id) AS document_count FROM once GROUP BY key),
tokened AS (SELECT *, list_filter(regexp_split_to_array(key, '[^a-z0-9]+'), lambda x: x <> '') AS tok FROM counted),
raw AS (
  SELECT *, len(list_filter(tok, lambda x: x IN {_in(BACKGROUND_WORDS)})) / greatest(len(tok), 1) AS bg,
    least(1.0, greatest(0.0, 0.18 + CASE WHEN kind <> 'phrase' THEN 0.42 ELSE 0 END + CASE WHEN kind = 'acronym' THEN 0.20 ELSE 0 END + CASE WHEN regexp_matches(surface, '[_.:/-]') THEN 0.18 ELSE 0 END
      + CASE WHEN regexp_matches(surface, '[a-z][A-Z]') THEN 0.18 ELSE 0 END + CASE WHEN regexp_matches(surface, '\\d') THEN 0.10 ELSE 0 END + CASE WHEN len(list_filter(tok, lambda x: x IN {_in(DOMAIN_HINTS)})) > 0 THEN 0.22 ELSE 0 END
      + CASE WHEN len(tok) >= 2 THEN 0.16 ELSE 0 END + 0.20 * (len(list_filter(tok, lambda x: x NOT IN {_in(BACKGROUND_WORDS)})) / greatest(len(tok), 1))))::DOUBLE AS j FROM tokened),
penal AS (
  SELECT *, least(1.0, greatest(0.0, CASE WHEN kind IN ('identifier', 'acronym') THEN 0.02 ELSE 0.06 END + 0.30 * bg + CASE WHEN len(tok) = 1 AND kind = 'phrase' AND tok[1] NOT IN {_in(DOMAIN_HINTS)} THEN 0.20 ELSE 0 END))::DOUBLE AS p FROM raw),
scored AS (
  SELECT key, surface, kind, occurrence_count, document_count, {_round4('j')} AS jargon_score, {_round4('p')} AS background_penalty,
    {_round4("least(1.0, greatest(0.0, 0.42::DOUBLE * j + 0.24::DOUBLE * least(1.0::DOUBLE, ln(1 + occurrence_count) / ln(11)) + 0.20::DOUBLE * least(1.0::DOUBLE, document_count / (SELECT count(*) FROM documents)) + 0.14::DOUBLE * least(1.0::DOUBLE, len(tok) / 3) - p))")} AS score
  FROM penal)
"""
ORACLE["scout_scored"] = f"{SCOUT} SELECT key, kind, occurrence_count, document_count, jargon_score, background_penalty, score FROM scored"
CLUSTER_KEY = f"array_to_string(list_transform({_frags('surface')}, lambda x: {_singular('x')}), ' ')"
ORACLE["scout_clusters"] = f"""{SCOUT}, k AS (SELECT *, {CLUSTER_KEY} AS cluster_key FROM scored)
SELECT cluster_key, first(surface ORDER BY score DESC, lower(surface), surface, key) AS representative, string_agg(surface, ',' ORDER BY score DESC, lower(surface), surface, key) AS surfaces, count(*)::INTEGER AS candidate_count,
  max(score) AS top_score, sum(occurrence_count)::BIGINT AS occurrence_count, max(document_count) AS document_count FROM k GROUP BY cluster_key"""
_D = "::DOUBLE"
TOP = f"""{SCOUT}, best AS (SELECT *, {CLUSTER_KEY} AS cluster_key FROM scored WHERE score >= 0.25 ORDER BY score DESC, jargon_score DESC, document_count DESC, occurrence_count DESC, key LIMIT 50),
sized AS (SELECT *, (count(*) OVER (PARTITION BY cluster_key))::INTEGER AS cluster_size, {_frags('surface')} AS f FROM best),
shaped AS (
  SELECT *, {_round4(f"least(1.0{_D}, 0.58{_D} * least(1.0{_D}, greatest(0, len(f) - 1) / 4) + 0.34{_D} * least(1.0{_D}, (len(regexp_extract_all(surface, '[^A-Za-z0-9 ]')) + len(regexp_extract_all(surface, '[a-z0-9][A-Z]')) + CASE WHEN regexp_matches(surface, '\\b[A-Z0-9]{{3,}}\\b') THEN 1 ELSE 0 END) / 4) + 0.35{_D} * least(1.0{_D}, len(regexp_extract_all(surface, '[0-9]')) / 4))")} AS token_fragmentation_score,
    {_round4(f"least(1.0{_D}, (CASE WHEN kind <> 'phrase' THEN 0.36 ELSE 0 END + CASE WHEN regexp_matches(surface, '[_.:/-]') THEN 0.26 ELSE 0 END + CASE WHEN regexp_matches(surface, '[a-z][A-Z]') THEN 0.22 ELSE 0 END + CASE WHEN regexp_full_match(surface, '[A-Z][A-Z0-9]{{2,}}') THEN 0.26 ELSE 0 END + CASE WHEN regexp_matches(surface, '[0-9]') THEN 0.14 ELSE 0 END + CASE WHEN length(surface) <= 4 AND upper(surface) = surface AND regexp_matches(surface, '[A-Za-z]') THEN 0.14 ELSE 0 END){_D})")} AS surface_shape_score FROM sized),
oov AS (SELECT *, {_round4(f"greatest(token_fragmentation_score, surface_shape_score * 0.92{_D})")} AS oov_score FROM shaped),
risky AS (SELECT *, {_round4(f"least(1.0{_D}, 0.46{_D} * oov_score + 0.24{_D} * surface_shape_score + 0.14{_D} * least(1.0{_D}, cluster_size / 3))")} AS surface_risk_score FROM oov),
prior AS (
  SELECT *, {_round4(f"least(1.0{_D}, greatest(0.0{_D}, 0.30{_D} * score + 0.22{_D} * jargon_score + 0.18{_D} * oov_score + 0.12{_D} * surface_risk_score + 0.08{_D} * least(1.0{_D}, document_count / 3) + 0.06{_D} * least(1.0{_D}, occurrence_count / 5) - 0.10{_D} * background_penalty))")} AS priority_score FROM risky),
final AS (
  SELECT *, CASE WHEN priority_score >= 0.55 THEN 'important' ELSE 'later' END AS priority,
    list_filter([CASE WHEN kind <> 'phrase' THEN 'code_style_surface' END, CASE WHEN oov_score >= 0.55 THEN 'high_oov_proxy' END, CASE WHEN surface_risk_score >= 0.55 THEN 'high_surface_risk' END, CASE WHEN jargon_score >= 0.70 THEN 'high_jargon_score' END,
      CASE WHEN document_count >= 2 THEN 'multi_document_signal' END, CASE WHEN cluster_size > 1 THEN 'clustered_variants' END], lambda x: x IS NOT NULL) AS reason_list FROM prior)
"""
ORACLE["scout_topk"] = f"{TOP} SELECT key, surface, kind, score, cluster_key, cluster_size, token_fragmentation_score, surface_shape_score, oov_score, surface_risk_score, priority_score, priority, array_to_string(reason_list, ',') AS reasons FROM final"
ORACLE["quality_reasons"] = f"{TOP} SELECT reason, count(*) AS n FROM (SELECT unnest(reason_list) AS reason FROM final) GROUP BY reason"
_MEAN = lambda c: _round4(f"coalesce(avg({c}), 0.0)")
ORACLE["quality_report"] = f"""{TOP} SELECT (SELECT count(*) FROM documents) AS document_count, 0::INTEGER AS cluster_count, count(*) AS candidate_count, count(*) FILTER (priority = 'important') AS important_count, count(*) FILTER (priority = 'later') AS later_count,
  count(*) FILTER (kind = 'identifier') AS identifier_count, count(*) FILTER (kind = 'acronym') AS acronym_count, count(*) FILTER (kind = 'code') AS code_count, count(*) FILTER (kind = 'phrase') AS phrase_count,
  count(*) FILTER (document_count >= 2) AS multi_document_count, count(*) FILTER (cluster_size > 1) AS clustered_count, 0::BIGINT AS with_negative_count, count(*) FILTER (oov_score >= 0.55) AS high_oov_count, count(*) FILTER (surface_risk_score >= 0.55) AS high_risk_count,
  {_MEAN('score')} AS average_score, {_MEAN('priority_score')} AS average_priority, {_MEAN('oov_score')} AS average_oov, coalesce(max(score), 0.0) AS top_score, {_round4("count(*) FILTER (priority = 'important') / count(*)")} AS important_ratio FROM final"""
COMPACT = "trim(regexp_replace(t, '\\s+', ' ', 'g'))"
ORACLE["scout_occurrences"] = f"""{TOP.replace('LIMIT 50', 'LIMIT 20')}, o AS (SELECT key, doc_id, line, row_number() OVER (PARTITION BY key ORDER BY doc_id, line) AS occ_ord FROM once WHERE key IN (SELECT key FROM final))
SELECT key, occ_ord::INTEGER AS occ_ord, doc_id AS doc_ord, line::INTEGER AS line, CASE WHEN length({COMPACT}) <= 220 THEN {COMPACT} ELSE left({COMPACT}, 219) || '…' END AS line_text FROM o JOIN rows USING (doc_id, line) WHERE occ_ord <= 5"""
ORACLE["evidence_positive"] = f"""{TOP.replace('LIMIT 50', 'LIMIT 20')}, o AS (SELECT key, doc_id, line, row_number() OVER (PARTITION BY key ORDER BY doc_id, line) AS ord FROM once WHERE key IN (SELECT key FROM final))
SELECT key, ord::INTEGER AS ord, doc_id AS doc_ord, line::INTEGER AS start_line, line::INTEGER AS end_line, trim(t) AS text FROM o JOIN rows USING (doc_id, line) WHERE ord <= 3"""

OVER = "list_filter(regexp_split_to_array(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^A-Za-z0-9]+'), lambda x: length(x) >= 3)"
ORACLE["evidence_negative"] = f"""WITH c AS (SELECT unnest(['that this', 'from the with', 'for and', 'The', 'ION', 'nicht eine', 'dans pour', 'para por']) AS surface), ct AS (SELECT lower(surface) AS key, {OVER.format('surface')} AS ts FROM c),
rows AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
lt AS (SELECT doc_id, line, t, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) AS norm, {OVER.format('t')} AS w FROM rows),
pair AS (SELECT key, ts, doc_id, line, t, list_filter(ts, lambda x: list_contains(w, x)) AS o FROM lt, ct WHERE NOT contains(norm, key)),
good AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, line) AS ord FROM pair WHERE CASE WHEN len(o) = 0 THEN false WHEN len(ts) = 1 THEN length(o[1]) >= 4 ELSE len(o) >= greatest(1, least(2, len(ts) - 1)) END)
SELECT key, ord::INTEGER AS ord, doc_id AS doc_ord, line::INTEGER AS start_line, trim(t) AS text, array_to_string(o, ' ') AS matched FROM good WHERE ord <= 3"""

_PLUS = len(INJECTED.split("\n")) - 1
ORACLE["safety_findings"] = f"""WITH d AS (SELECT doc_id, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) + {_PLUS} AS n FROM documents WHERE doc_id % 17 = 0), hit AS (SELECT doc_id, n, unnest([1, 2]) AS k FROM d)
SELECT doc_id, CASE k WHEN 1 THEN 'ignore_previous_instructions' ELSE 'role_override' END AS rule_id, CASE k WHEN 1 THEN 'high' ELSE 'medium' END AS risk, n::INTEGER AS line_number,
  CASE k WHEN 1 THEN 'ignore previous instructions' ELSE 'act as admin' END AS matched_text, 'line' AS scope FROM hit"""
ORACLE["safety_rollup"] = "SELECT doc_id, (CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END)::BIGINT AS high_count, (CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END)::BIGINT AS medium_count, 0::BIGINT AS low_count, CASE WHEN doc_id % 17 = 0 THEN 'high' ELSE 'none' END AS highest_risk, CASE WHEN doc_id % 17 = 0 THEN 'block_llm_review' ELSE 'allow' END AS action FROM documents"
ORACLE["safety_sanitize"] = """WITH s AS (SELECT page_id, replace(replace(replace(replace(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g'), '```', '` ` `'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM pages)
SELECT page_id, t AS safe, CASE WHEN length(t) > 400 THEN left(t, 399) || '…' ELSE t END AS beginning FROM s"""
ORACLE["semantic_rerank"] = f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.v AS va, b.v AS vb FROM e a JOIN e b ON b.vec_id - a.vec_id BETWEEN 1 AND 3),
far AS (SELECT a.vec_id AS a, a.vec_id + k AS b FROM e a, (VALUES (1), (2), (3)) n(k) WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.vec_id = a.vec_id + k)),
s AS (SELECT a, b, CASE WHEN b % 4 <> 0 THEN list_sum(list_transform(list_zip(va, vb), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(va, lambda x: x * x))) * sqrt(list_sum(list_transform(vb, lambda x: x * x)))) ELSE -1.0 END AS c FROM p UNION ALL SELECT a, b, -1.0 FROM far)
SELECT 'v' || a AS name, 'v' || b AS canonical, b % 4 <> 0 AS escalate, {_round4('c')} AS semantic FROM s WHERE b % 4 = 0 OR c >= 0 OR c = -1"""

CODE = f"""code AS (SELECT DISTINCT 'src/' || (text_id % 100) || '.py' AS path, (text_id % 1000000000)::INTEGER AS line_number,
  text || CASE text_id % 5 WHEN 0 THEN ' stock_' || noun || '_ledger' WHEN 1 THEN ' tmp_value' ELSE '' END AS text, text_id % 7 AS kind, adj, noun, text_id % 5 AS extra FROM texts)"""
DRIFT = f"WITH {CATALOG}, {TEXTS}, {CODE}, numbered AS (SELECT path, line_number, text, row_number() OVER () AS text_id FROM (SELECT DISTINCT path, line_number, text FROM code)), {_matching('numbered')}, {LONG}, {ONE}"
ORACLE["drift_known"] = f"{DRIFT} SELECT path, line_number, term_id, first(surface ORDER BY \"start\") AS surface, matched_text FROM one JOIN (SELECT text_id, path, line_number FROM numbered) USING (text_id) GROUP BY path, line_number, term_id, matched_text"
ORACLE["near_miss_components"] = f"""WITH {CATALOG}, q AS (
  SELECT DISTINCT unnest([adj || upper(left(noun, 1)) || substr(noun, 2, length(noun) - 2), 'tiny_' || noun, adj || '-limit']) AS name, unnest([[adj, left(noun, length(noun) - 1)], ['tiny', noun], [adj, 'limit']]) AS qf, unnest(['camel', 'snake', 'kebab']) AS qs FROM term),
k AS (
  SELECT term_id, [adj, noun] AS tf, unnest([canonical, adj || upper(left(noun, 1)) || substr(noun, 2), upper(left(adj, 1)) || substr(adj, 2) || upper(left(noun, 1)) || substr(noun, 2), adj || '_' || noun, upper(adj || '_' || noun), adj || '-' || noun]) AS known,
    unnest(['phrase', 'camel', 'camel', 'snake', 'snake', 'kebab']) AS ks FROM term WHERE NOT deprecated
  UNION ALL SELECT term_id, [noun], noun, 'word' FROM term WHERE NOT deprecated),
p AS (SELECT *, list_filter(qf, lambda x: list_contains(tf, x)) AS s FROM q, k)
SELECT name, term_id, known, array_to_string(s, ',') AS shared, {_round4('len(s) / len(list_distinct(list_concat(qf, tf)))')} AS raw_jaccard, qf[1] = tf[1] AS same_prefix, qf[-1] = tf[-1] AS same_suffix,
  {_round4("least(1.0::DOUBLE, (CASE WHEN len(qf) = len(tf) THEN 0.45 ELSE 0 END)::DOUBLE + (CASE WHEN qs = ks THEN 0.35 ELSE 0 END)::DOUBLE + (CASE WHEN length(qf[-1]) = length(tf[-1]) THEN 0.10 ELSE 0 END)::DOUBLE + (CASE WHEN length(qf[1]) = length(tf[1]) THEN 0.10 ELSE 0 END)::DOUBLE)")} AS shape_score FROM p WHERE len(s) > 0"""
ORACLE["diff_items"] = f"""WITH {CATALOG},
e AS (SELECT *, CASE WHEN canonical = 'red ring' THEN 'ruby ring' ELSE canonical END AS c2 FROM term)
SELECT 'added' AS change, 'term' AS object_kind, unnest(['part.theirs_only', 'part.shared', 'part.clash']) AS object_id, NULL AS field, NULL AS "before", NULL AS "after"
UNION ALL SELECT 'added', 'tool', term_id || ':catalog.scan', NULL, NULL, NULL FROM e WHERE noun = 'gear'
UNION ALL SELECT 'changed', 'term', term_id, 'deprecated', 'false', 'true' FROM e WHERE noun = 'rod' AND NOT deprecated
UNION ALL SELECT 'changed', 'term', term_id, 'canonical', '"red ring"', '"ruby ring"' FROM e WHERE canonical = 'red ring'
UNION ALL SELECT 'changed', 'term', term_id, 'description', 'null', '"a bolt"' FROM e WHERE canonical = 'small bolt'
UNION ALL SELECT 'changed', 'term', term_id, 'metadata', '{{}}', '{{"finish":"matte"}}' FROM e WHERE noun = 'plate'
UNION ALL SELECT 'changed', 'alias', term_id || ':' || noun, 'case_sensitive', 'false', 'true' FROM e WHERE noun = 'anvil'"""
ORACLE["diff_summary"] = f"""WITH {CATALOG}, i AS (SELECT 'added' AS change FROM range(3) UNION ALL SELECT 'removed' FROM term WHERE canonical = 'small bolt' UNION ALL SELECT 'changed' FROM term WHERE noun IN ('gear', 'ring'))
SELECT 'term' AS object_kind, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, count(*) AS total FROM i"""
ORACLE["merge_terms"] = f"""WITH {CATALOG}, m AS (
  SELECT term_id, CASE WHEN noun = 'gear' THEN canonical || ' wheel' WHEN canonical = 'red ring' THEN 'ruby ring' ELSE canonical END AS canonical, NULL AS description, CASE WHEN noun = 'ring' THEN 'catalog,jewel' ELSE 'catalog' END AS tags,
    'catalog.update_' || noun || CASE WHEN noun = 'gear' THEN ',catalog.scan' ELSE '' END AS tools, deprecated OR noun = 'rod' AS deprecated, CASE WHEN noun = 'plate' THEN '{{"finish":"matte"}}' ELSE '{{}}' END AS metadata,
    CASE WHEN noun = 'gear' OR canonical = 'red ring' THEN 'merge' WHEN noun = 'ring' THEN 'ours' WHEN (noun = 'rod' AND NOT deprecated) OR noun IN ('plate', 'anvil') THEN 'theirs' WHEN noun = 'rod' THEN 'base' ELSE 'base' END AS side
  FROM term WHERE canonical <> 'small bolt')
SELECT term_id, side, canonical, description, tags, tools, deprecated, metadata FROM m
UNION ALL SELECT 'part.ours_only', 'ours', 'ours only', NULL, '', '', false, '{{}}' UNION ALL SELECT 'part.theirs_only', 'theirs', 'theirs only', NULL, '', '', false, '{{}}' UNION ALL SELECT 'part.shared', 'ours', 'shared part', NULL, '', '', false, '{{}}'"""
ORACLE["merge_conflicts"] = f"""WITH {CATALOG} SELECT 'term' AS object_kind, 'part.clash' AS object_id, NULL AS field, 'both sides added different objects' AS reason
UNION ALL SELECT 'term', term_id, NULL, 'ours removed object while theirs changed it' FROM term WHERE canonical = 'small bolt'"""
ORACLE["merge_aliases"] = f"WITH {CATALOG} SELECT term_id, noun AS surface, noun = 'anvil' AS case_sensitive FROM term WHERE canonical <> 'small bolt'"
ORACLE["merge_warnings"] = f"""WITH {CATALOG} SELECT 'canonical_rename_with_parallel_term_change' AS kind, term_id AS object_id, canonical AS base, CASE WHEN noun = 'gear' THEN canonical || ' wheel' ELSE canonical END AS ours,
  CASE WHEN canonical = 'red ring' THEN 'ruby ring' ELSE canonical END AS theirs FROM term WHERE noun = 'gear' OR canonical = 'red ring'"""
ORACLE["migrations_explicit"] = f"""WITH {CATALOG} SELECT o.term_id, n.term_id AS new_id, 0.95 AS confidence, 'medium' AS risk, 'explicit_replacement' AS match_kind FROM term o JOIN term n ON o.deprecated AND n.adj = 'new' AND n.noun = o.noun"""
ORACLE["lint_findings"] = f"""WITH {CATALOG}, t AS (SELECT term_id, noun, deprecated, CASE noun WHEN 'gear' THEN 'limit' WHEN 'rod' THEN 'ab' END AS c FROM term)
SELECT unnest(list_filter([CASE WHEN c = 'ab' THEN 'short_surface' END, CASE WHEN c = 'limit' THEN 'broad_surface' END, CASE WHEN deprecated THEN 'deprecated_broad_surface' END, 'tool_broad_surface'], lambda x: x IS NOT NULL)) AS code, term_id, c AS surface, 'canonical' AS kind FROM t WHERE c IS NOT NULL"""
ORACLE["surface_collisions"] = f"WITH {CATALOG} SELECT string_agg(term_id, ',' ORDER BY term_id) AS term_ids, noun AS surfaces, 'all' AS scopes, noun AS search_surfaces FROM term GROUP BY noun HAVING count(*) > 1"
ORACLE["alias_collisions"] = f"WITH {CATALOG} SELECT noun AS surface_key, string_agg(term_id, ',' ORDER BY term_id) AS term_ids FROM term WHERE NOT deprecated GROUP BY noun HAVING count(*) > 1"
ORACLE["dangling_refs"] = f"""WITH {CATALOG}, kept AS (SELECT * FROM term WHERE canonical <> 'new gear')
SELECT 'unknown scope' AS problem, term_id AS object_id, adj AS detail FROM kept WHERE adj IN ('red', 'small')
UNION ALL SELECT 'unknown scope', noun, adj FROM term WHERE adj IN ('red', 'small') AND noun <> 'gear'
UNION ALL SELECT 'replacement does not exist', term_id, 'part.new_gear' FROM kept WHERE deprecated AND noun = 'gear'"""
EVENTS = """ev AS (SELECT event_id, event_id AS seq, 'term ' || (user_id % 500) AS key, CASE event_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'ambiguous' ELSE 'needs_split' END AS decision,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE 'note ' || event_id END AS note, 'user' || user_id AS reviewer, ts AS created_at FROM events)"""
ORACLE["latest_decisions"] = f"WITH {EVENTS} SELECT key, first(decision ORDER BY created_at DESC, seq DESC) AS decision, first(reviewer ORDER BY created_at DESC, seq DESC) AS reviewer, min(created_at) AS created_at, max(created_at) AS updated_at FROM ev GROUP BY key"
ORACLE["review_events_filtered"] = f"WITH {EVENTS} SELECT event_id::VARCHAR AS event_id, key, note, reviewer FROM ev WHERE decision = 'accepted'"
ITEMS = """items AS (SELECT p_partkey::VARCHAR AS key, p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'limit' WHEN 1 THEN replace(p_name, ' ', '_') ELSE p_name END AS surface, (p_partkey % 100) / 100 AS score, (p_partkey % 7) / 10 AS jargon_score,
  (p_partkey % 4)::INTEGER AS positive_count, (p_partkey % 3)::INTEGER AS negative_count, CASE WHEN p_partkey % 9 = 0 THEN 'high' ELSE 'none' END AS highest_risk FROM part)"""
ORACLE["review_inbox"] = f"""WITH {ITEMS} SELECT key, surface || '#' || key AS surface, score, positive_count, CASE WHEN k % 3 = 0 THEN 'accepted' END AS decision FROM items
ORDER BY CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END, score DESC, surface || '#' || key LIMIT 100"""
JUDGED = f"""judged AS (SELECT *, CASE WHEN highest_risk = 'high' THEN 1 WHEN positive_count = 0 THEN 2 WHEN surface IN {_in(GENERIC_SURFACES)} OR (score < 0.3 AND jargon_score < 0.35) THEN 3
  WHEN negative_count >= positive_count AND score < 0.65 THEN 4 WHEN score >= 0.6 OR jargon_score >= 0.65 OR contains(surface, '_') THEN 5 ELSE 6 END AS step FROM items),
reviewed AS (SELECT *, CASE step WHEN 3 THEN 'reject' WHEN 4 THEN 'needs_split' WHEN 5 THEN 'accept' ELSE 'needs_more_evidence' END AS recommendation,
  CASE step WHEN 1 THEN 0.4 WHEN 2 THEN 0.35 WHEN 3 THEN 0.68 WHEN 4 THEN 0.62 WHEN 5 THEN least(0.92, greatest(0.7, score + 0.15)) ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN step = 3 THEN '' ELSE replace(surface, '_', ' ') END AS canonical_name,
  CASE step WHEN 1 THEN 'prompt_injection_high' WHEN 2 THEN 'missing_positive_evidence' WHEN 3 THEN 'generic_surface' WHEN 4 THEN 'ambiguous_evidence' ELSE '' END AS flags FROM judged)"""
ORACLE["review_heuristic"] = f"WITH {ITEMS}, {JUDGED} SELECT key, recommendation, {_round4('confidence')} AS confidence, canonical_name, flags, step <> 1 AS llm_review_allowed FROM reviewed"
ORACLE["consensus_votes"] = f"""WITH {ITEMS}, {JUDGED}, s AS (SELECT 'g' || (k % 40) AS key, k AS seq, recommendation, confidence, CASE WHEN recommendation = 'accept' THEN lower(canonical_name) ELSE '' END AS vote FROM reviewed WHERE highest_risk = 'none'),
g AS (SELECT key, recommendation, vote, count(*) AS n, avg(confidence) AS mean, min(seq) AS f FROM s GROUP BY ALL), t AS (SELECT key, count(*) AS total FROM s GROUP BY key),
top AS (SELECT *, {_round4('n / total')} AS ratio, {_round4('mean')} AS m FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, {_round4('mean')} DESC, f) AS r FROM g) JOIN t USING (key) WHERE r = 1)
SELECT key, CASE WHEN ratio >= 0.3 AND m >= 0.5 THEN 'consensus' ELSE 'abstain' END AS status, CASE WHEN ratio >= 0.3 AND m >= 0.5 THEN recommendation ELSE 'needs_more_evidence' END AS recommendation, total AS sample_count, n AS agreement_count, ratio AS agreement_ratio FROM top"""
ORACLE["dataset_quality"] = """WITH e AS (SELECT event_id AS n, CASE WHEN event_id % 2 = 0 THEN 'one ' || event_id ELSE 'term ' || (user_id % 500) END AS key, event_id % 4 AS d FROM events), c AS (SELECT key, count(DISTINCT d) AS m FROM e GROUP BY key),
f AS (SELECT n, m, list_filter([CASE WHEN n % 13 = 0 THEN 'missing_candidate_snapshot' END, CASE WHEN n % 7 = 0 THEN 'missing_evidence_snapshot' END, CASE WHEN n % 7 <> 0 AND n % 5 = 0 THEN 'missing_positive_evidence' END, CASE WHEN n % 3 = 0 THEN 'missing_review_note' END], lambda x: x IS NOT NULL) AS fl,
  n % 13 = 0 OR n % 7 = 0 OR n % 5 = 0 AS gap FROM e JOIN c USING (key)),
q AS (SELECT n, CASE WHEN n % 11 = 0 THEN 'unsafe' WHEN m > 1 THEN 'conflicting' WHEN gap THEN 'incomplete' WHEN n % 10 < 3 THEN 'low_signal' ELSE 'usable' END AS quality, fl FROM f)
SELECT n::VARCHAR AS event_id, quality, (CASE quality WHEN 'unsafe' THEN 0.0 WHEN 'conflicting' THEN 0.25 WHEN 'incomplete' THEN 0.35 WHEN 'low_signal' THEN 0.6 ELSE CASE WHEN len(fl) = 0 THEN 1.0 ELSE 0.85 END END)::DOUBLE AS quality_score,
  CASE quality WHEN 'unsafe' THEN 'unsafe_prompt_evidence' WHEN 'conflicting' THEN 'conflicting_human_decisions' WHEN 'incomplete' THEN array_to_string(fl, ',') WHEN 'low_signal' THEN array_to_string(list_append(fl, 'low_signal_candidate'), ',') ELSE CASE WHEN len(fl) = 0 THEN 'review_example_complete' ELSE array_to_string(fl, ',') END END AS flags FROM q"""
ORACLE["policy_matrix"] = """WITH m AS (SELECT unnest(['solo', 'team', 'locked']) AS mode), a AS (SELECT unnest(['read_workspace', 'sync_workspace', 'review_candidate', 'export_review_events', 'publish_snapshot', 'run_llm_review', 'manage_policy']) AS action), r AS (SELECT unnest(['owner', 'maintainer', 'reviewer', 'agent', 'reader']) AS role)
SELECT mode, action, role, mode = 'solo' OR action = 'read_workspace' OR role = 'owner' OR (mode = 'team' AND ((role = 'maintainer' AND action IN ('sync_workspace', 'review_candidate', 'export_review_events', 'publish_snapshot', 'run_llm_review')) OR (role = 'reviewer' AND action IN ('review_candidate', 'export_review_events')))) AS allowed FROM m, a, r"""
ORACLE["snapshot_new_terms"] = f"""WITH {CATALOG}, {ITEMS}, known AS (SELECT canonical AS x FROM term UNION SELECT noun FROM term), fresh AS (SELECT key, surface, regexp_replace(lower(surface), '[^a-z0-9]+', '_', 'g') AS base FROM items WHERE lower(surface) NOT IN (SELECT x FROM known)),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY key) AS n FROM fresh) SELECT key, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS term_id, replace(surface, '_', ' ') AS canonical FROM n"""
