"""SQL twins of queries over strings, nested records, uploads and spans."""

from __future__ import annotations

from termweave.plans.channel_queries import SQL as CHANNEL_SQL
from termweave.plans.search_queries import _FOLD, _KIND, _TEXTS, _TOK, _WORTH, DICT_SQL, RUNS_SQL, VARIANTS_SQL, _hits_sql, edit_sql

_WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"
_LEAD = lambda c: f"length({c}) - length(regexp_replace({c}, '^{_WS}+', ''))"
_BARE = lambda c: f"regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', '')"
#: par: doc_id, start, end, text of each paragraph.
PARAGRAPHS_SQL = f"""cutup AS (SELECT doc_id, string_split_regex(text, '\\n{_WS}*\\n') AS part, list_transform(regexp_extract_all(text, '\\n{_WS}*\\n'), lambda x: length(x)) AS gap FROM documents WHERE text IS NOT NULL),
piece AS (SELECT doc_id, part, gap, unnest(range(1, len(part) + 1)) AS k FROM cutup),
par0 AS (SELECT doc_id, part[k] AS p, coalesce(list_sum(list_transform(part[1:k - 1], lambda x: length(x))), 0) + coalesce(list_sum(gap[1:k - 1]), 0) AS pos FROM piece),
par AS (SELECT doc_id, CAST(pos + {_LEAD('p')} AS BIGINT) AS "start", CAST(pos + {_LEAD('p')} + length({_BARE('p')}) AS BIGINT) AS "end", {_BARE('p')} AS text FROM par0 WHERE {_BARE('p')} <> '')"""

_LIST = lambda c: f"CASE WHEN {c} IS NULL OR json_type({c}) = 'NULL' THEN [] WHEN json_type({c}) = 'ARRAY' THEN json_extract({c}, '$[*]') ELSE [{c}] END"
_TEXT = lambda c: f"coalesce(json_extract_string({c}, '$'), '')"


_NESTED = f"""m AS (SELECT rec_id, unnest(l) AS j, CAST(unnest(range(0, len(l))) AS VARCHAR) AS node FROM (SELECT response_id AS rec_id, {_LIST("json_extract(body, '$.mappings')")} AS l FROM map_responses WHERE body IS NOT NULL)),
c AS (SELECT rec_id, unnest(l) AS j, node || '.' || unnest(range(0, len(l))) AS node FROM (SELECT rec_id, node, {_LIST("json_extract(j, '$.candidates')")} AS l FROM m WHERE json_type(j) <> 'NULL')),
s AS (SELECT rec_id, unnest(l) AS j, node || '.' || unnest(range(0, len(l))) AS node FROM (SELECT rec_id, node, {_LIST("json_extract(j, '$.mappingProvenance')")} AS l FROM c WHERE json_type(j) <> 'NULL')),
a AS (SELECT rec_id, unnest(l) AS j, node || '.' || unnest(range(0, len(l))) AS node FROM (SELECT rec_id, node, {_LIST("json_extract(j, '$.supportingProvenance')")} AS l FROM c WHERE json_type(j) <> 'NULL')),
a2 AS (SELECT rec_id, unnest(l) AS j, node || '.' || unnest(range(0, len(l))) AS node FROM (SELECT rec_id, node, {_LIST('j')} AS l FROM a WHERE json_type(j) <> 'NULL')),
d AS (SELECT annotation_id AS rec_id, 1 AS depth, unnest({_LIST("json_extract(body, '$.derivedFrom')")}) AS j FROM v2_annotations WHERE body IS NOT NULL
  UNION ALL SELECT rec_id, depth + 1, unnest({_LIST("json_extract(j, '$.derivedFrom')")}) FROM d WHERE json_type(j) <> 'NULL')"""
_P6 = f"""SELECT 'candidate' AS kind, rec_id, node, {_TEXT("json_extract(j, '$.label')")} AS val FROM c WHERE json_type(j) <> 'NULL'
UNION ALL SELECT 'step', rec_id, node, {_TEXT("json_extract(j, '$.method')")} FROM s WHERE json_type(j) <> 'NULL'
UNION ALL SELECT 'support', rec_id, node, {_TEXT("json_extract(j, '$.method')")} FROM a2 WHERE json_type(j) <> 'NULL'
UNION ALL SELECT 'derived', rec_id, CAST(depth AS VARCHAR), {_TEXT("json_extract(j, '$.provenance.evidence')")} FROM d WHERE json_type(j) <> 'NULL'"""

_ESC = lambda c: f"regexp_escape({c})"
_FIELD = f"(?:[^' || {_ESC('d')} || {_ESC('q')} || ']*|' || {_ESC('q')} || '(?:[^' || {_ESC('q')} || ']|' || {_ESC('q')} || {_ESC('q')} || ')*' || {_ESC('q')} || ')"
#: line: raw_id, whether quoting is right, fields, wanted columns and the four checked fields of each line of a known format.
LINES_SQL = f"""r AS (SELECT raw_id, line, delimiter AS d, quote_char AS q, string_split(column_list, ',') AS cols FROM raw_uploads JOIN upload_formats USING (format_id)),
r1 AS (SELECT *, regexp_full_match(line, '(?s){_FIELD}(?:' || {_ESC('d')} || '{_FIELD})*') AS ok, string_split(line, q) AS p FROM r),
r2 AS (SELECT *, string_split(array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 THEN x WHEN x = '' AND i > 1 AND i < len(p) THEN q ELSE replace(x, d, chr(1)) END), ''), chr(1)) AS f FROM r1),
line AS (SELECT raw_id, ok, f, cols, f[list_position(cols, 'row_no')] AS row_no, f[list_position(cols, 'propertyValue')] AS propertyValue, f[list_position(cols, 'propertyType')] AS propertyType, f[list_position(cols, 'submitted')] AS submitted, f[list_position(cols, 'note')] AS note FROM r2)"""
_VALID = """(regexp_full_match(row_no, '[0-9]{1,12}') AND regexp_matches(propertyValue, '[\\p{L}\\p{N}]') AND NOT regexp_matches(propertyValue, '[\\x00-\\x09\\x0B-\\x1F\\x{FFFD}]')
  AND (propertyType = '' OR propertyType IN (SELECT type_name FROM property_types)) AND regexp_full_match(submitted, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') AND submitted NOT LIKE '0000%' AND try_strptime(submitted, '%Y-%m-%d %H:%M:%S') IS NOT NULL)"""

_BLEND = f"greatest({edit_sql('a', 'b')}, CASE WHEN len(ga) = 0 AND len(gb) = 0 THEN 1.0 WHEN len(ga) = 0 OR len(gb) = 0 THEN 0.0 ELSE len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))) END)"

SQL = {
    "edit_blended": f"SELECT id, round({edit_sql('a', 'b')}, 6) AS edit, round({_BLEND}, 6) AS blended FROM (SELECT id, {_FOLD('property_value')} AS a, {_FOLD('term_label')} AS b, {_TOK('property_value')} AS ga, {_TOK('term_label')} AS gb FROM votes)",
    "query_variants": f"WITH {_TEXTS}, {VARIANTS_SQL} SELECT text, array_to_string(variants, ' | ') AS variants FROM vars",
    "variant_attribution": f"""WITH {DICT_SQL}, {_TEXTS}, {VARIANTS_SQL}, each AS (SELECT text, unnest(list_concat([text], variants)) AS variant, unnest(range(0, len(variants) + 1)) AS ord FROM vars),
best AS (SELECT text, iri, min({{'o': ord, 't': string_type, 'v': variant}}) AS b FROM each JOIN dict ON lower(variant) = surface GROUP BY ALL)
SELECT text, iri, b.v AS variant, CASE b.t WHEN 'label' THEN 'OLS_TEXT_TAGGER' ELSE 'OLS_TEXT_TAGGER_SYNONYM' END AS kind, round(CAST(CASE b.t WHEN 'label' THEN 1.0 ELSE 0.9 END AS DOUBLE) * CASE WHEN b.o > 0 THEN 0.95 ELSE 1 END, 6) AS confidence FROM best""",
    "tag_values": f"WITH {DICT_SQL}, {_TEXTS}, {RUNS_SQL}, {_hits_sql('dict', 'hit')} SELECT text, iri, kind, round(coverage, 6) AS coverage, round({_WORTH}, 6) AS confidence FROM (SELECT *, {_KIND} AS kind FROM hit)",
    "paragraph_rows": f"WITH {PARAGRAPHS_SQL} SELECT doc_id, \"start\", \"end\", text FROM par",
    "unique_segments": f"WITH {PARAGRAPHS_SQL} SELECT doc_id, text FROM (SELECT doc_id, arg_min(text, \"start\") AS text FROM par GROUP BY doc_id, lower(text))",
    "gap_fill": f"""WITH {PARAGRAPHS_SQL}, edge AS (SELECT doc_id, "start", "end" FROM par UNION ALL SELECT doc_id, length(text), length(text) FROM documents WHERE text IS NOT NULL)
SELECT * FROM (SELECT doc_id, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start", "end"), 0) AS gap_start, "start" AS gap_end FROM edge) WHERE gap_start < gap_end""",
    "greedy_spans": f"""WITH span AS ({CHANNEL_SQL['tag_spans']}), l AS (SELECT doc_id, list_sort(list(DISTINCT {{'s': "start", 'e': "end"}})) AS l FROM span GROUP BY doc_id),
k AS (SELECT doc_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN x[1].s >= acc[len(acc)].e THEN list_concat(acc, x) ELSE acc END)) AS k FROM l) SELECT doc_id, k.s AS "start", k.e AS "end" FROM k""",
    "response_flat": f"""WITH RECURSIVE {_NESTED}, x AS (SELECT rec_id, node, TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) AS v FROM c WHERE json_type(j) <> 'NULL')
SELECT rec_id AS response_id, node, round(v, 6) AS confidence, CASE WHEN v IS NULL THEN NULL WHEN v >= 0.9 THEN 'HIGH' WHEN v >= 0.7 THEN 'GOOD' WHEN v >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM x""",
    "p6_found": f"WITH RECURSIVE {_NESTED} {_P6}",
    "p6_flat": f"""WITH RECURSIVE {_NESTED}, o AS ({_P6}) SELECT kind, rec_id, node, CASE WHEN kind <> 'derived' THEN regexp_replace(node, '\\.[^.]*$', '') WHEN node = '1' THEN '' ELSE CAST(CAST(node AS INTEGER) - 1 AS VARCHAR) END AS parent, val FROM o""",
    "p3_found": f"""WITH {LINES_SQL} SELECT raw_id, CASE WHEN NOT ok THEN 'quoting' WHEN len(f) <> len(cols) THEN 'column_count' ELSE 'invalid_value' END AS reason FROM line WHERE NOT ok OR len(f) <> len(cols) OR NOT coalesce({_VALID}, false)""",
    "p3_loaded": f"""WITH {LINES_SQL} SELECT raw_id, CAST(row_no AS BIGINT) AS row_no, propertyValue, nullif(propertyType, '') AS propertyType, note, CAST(submitted AS TIMESTAMP) AS submitted FROM line WHERE ok AND len(f) = len(cols) AND {_VALID}""",
}
