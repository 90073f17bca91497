"""DuckDB SQL for the queries that SQL can express on whole tables."""

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: ASCII lower case: no other letter changes.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM texts),
keyed AS (SELECT doc_id, line, pos, {LOWER.format(f"trim(line, {BLANKS})")} AS key FROM lines),
often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.line, k.pos, o.keeper IS NOT NULL AND o.keeper <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

NEAR_DEDUP = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words),
sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
class AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS same, min(doc_id) AS rep, any_value(s) AS s, any_value(n) AS n FROM sized WHERE n > 0 GROUP BY 1),
shingles AS (SELECT rep, n, hash(unnest(s)) AS g FROM class),
rare AS (SELECT rep, n, g, row_number() OVER (PARTITION BY rep ORDER BY f, g) AS k
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS f FROM shingles)),
prefix AS (SELECT * FROM rare WHERE k <= n - ceil(0.75 * n) + 1),
candidate AS (
  SELECT DISTINCT a.rep AS u, b.rep AS v FROM prefix a JOIN prefix b
  ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
link AS (
  SELECT u, v FROM candidate JOIN class a ON a.rep = u JOIN class b ON b.rep = v
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 75 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach(node, root) AS (
  SELECT rep, rep FROM class UNION SELECT e.v, r.root FROM reach r JOIN edge e ON e.u = r.node),
part AS (SELECT node, min(root) AS component FROM reach GROUP BY node)
SELECT d.doc_id, d.n AS n_shingles, coalesce(p.component, d.doc_id) AS component_id, d.doc_id = coalesce(p.component, d.doc_id) AS kept
FROM sized d LEFT JOIN class c ON d.n > 0 AND c.same = md5(array_to_string(list_sort(d.s), chr(10)))
LEFT JOIN part p ON p.node = c.rep
"""

ORACLE_SQL = {"op4_line_dedup": LINE_DEDUP, "op9_minhash_dedup": NEAR_DEDUP}
