"""SQL twins of the service end to end: evidence of tagging, searching and cross-references, exchanged, reduced by the rules and ranked."""

from __future__ import annotations

from termweave.operators import search
from termweave.plans import rule_queries as rq
from termweave.plans.filters import Filter
from termweave.plans.search_queries import _DEAD, _SETTLE, _TEXTS, _XREFS, TAGGED_SQL, _sl, lexical_sql
from termweave.sinks import responses
from termweave.sources.adapter import NAMES_SQL

_WALK = f"""walk AS (SELECT iri AS origin, [iri] AS seen, term_replaced_by AS nxt, 0 AS hops, CAST(NULL AS VARCHAR) AS iri, true AS dead FROM ols_terms WHERE iri IS NOT NULL AND {_DEAD}
  UNION ALL SELECT origin, list_append(seen, t.iri), t.term_replaced_by, hops + 1, t.iri, (coalesce(t.is_obsolete <> 0, false) OR coalesce(lower(t.label) LIKE 'obsolete%', false)) FROM walk JOIN ols_terms t ON t.iri = walk.nxt WHERE walk.dead AND hops < 5 AND NOT list_contains(seen, walk.nxt)),
ends AS (SELECT o.iri AS origin, w.iri AS "to" FROM ols_terms o LEFT JOIN (SELECT * FROM walk WHERE NOT dead) w ON w.origin = o.iri WHERE {_DEAD.replace('label', 'o.label').replace('is_obsolete', 'o.is_obsolete')}),
props AS (SELECT CASE WHEN propertyType IN ('', 'unspecified') THEN NULL ELSE propertyType END AS property_type, propertyValue AS text, min(row_id) AS prop_id FROM text_to_map WHERE trim(propertyValue) <> '' GROUP BY ALL)"""


def _live(source: str, out: str) -> str:
    return f"""{out} AS (SELECT text, seq, coalesce(n.iri, e.iri) AS iri, CASE WHEN n.iri IS NULL THEN e.term_id ELSE n.short_form END AS term_id, CASE WHEN n.iri IS NULL THEN e.label ELSE n.label END AS label,
  CASE WHEN n.iri IS NULL THEN e.ontology ELSE n.ontology_name END AS ontology, kind, confidence, datasource FROM {source} e LEFT JOIN ends ON origin = e.iri LEFT JOIN ols_terms n ON n.iri = "to" WHERE origin IS NULL OR "to" IS NOT NULL)"""


def _evidence(f: Filter, return_all: bool) -> str:
    targets = _sl(f.targets) if f.targets else "('')"
    settled = "false" if return_all else _SETTLE + (f" AND lower(source) IN {targets}" if f.targets else "")
    lexical = lexical_sql(f, search.LEXICAL).replace(f"{NAMES_SQL}, {_TEXTS},\n", "", 1)
    parts = [
        TAGGED_SQL,
        lexical,
        _WALK,
        f"""done AS (SELECT DISTINCT text FROM tags WHERE {settled}),
engine AS (SELECT l.text, l.iri, l.short_form AS term_id, t.label, l.ontology, l.kind, l.confidence, l.ontology AS datasource, printf('%02d|%012.9f|%s', 1, 2 - l.confidence, l.iri) AS seq FROM lex l JOIN ols_terms t USING (iri) WHERE l.text NOT IN (SELECT text FROM done)),
e0 AS (SELECT * FROM engine UNION ALL SELECT g.text, g.iri, g.short_form, t.label, t.ontology_name, g.kind, g.confidence, g.source, printf('%02d|%012.9f|%s', g.channel, 2 - g.confidence, g.iri) FROM tags g JOIN ols_terms t USING (iri))""",
    ]
    if f.targets and not return_all:
        prefix = "lower(split_part(regexp_extract(iri, '([^/#]*)$', 1), '_', 1))"
        parts += [
            _live("e0", "judged"),
            _XREFS,
            f"""sat AS (SELECT DISTINCT text FROM judged WHERE confidence >= 0.7 AND ({rq._target(f.targets)}) IS NOT NULL),
seed AS (SELECT * FROM engine WHERE text NOT IN (SELECT text FROM sat)), open AS (SELECT text FROM seed GROUP BY text HAVING NOT bool_or({prefix} IN {targets})),
e1 AS (SELECT * FROM e0 UNION ALL SELECT text, target_iri, coalesce(t.short_form, target_id), CASE WHEN t.iri IS NULL THEN text ELSE t.label END, t.ontology_name, kind, confidence * 0.95, coalesce(t.ontology_name, lower(split_part(target_id, ':', 1))), '04|' || seq || '|' || target_iri || '|1'
  FROM seed JOIN open USING (text) JOIN xr ON source_iri = seed.iri LEFT JOIN ols_terms t ON t.iri = target_iri WHERE lower(split_part(target_id, ':', 1)) IN {targets})""",
        ]
    parts += [_live("e1" if f.targets and not return_all else "e0", "lv"), "ev AS (SELECT prop_id, property_type, lv.* FROM props JOIN lv USING (text))"]
    return "WITH RECURSIVE " + ",\n".join(parts)


_RANKED = "row_number() OVER (PARTITION BY prop_id ORDER BY x.confidence DESC, rank, pos)"
_SOFT = Filter(targets=("dizo", "phexo"))
_RULES = (rq._C, rq._prior("c", "p"), rq._corroborate("p", "k"), rq._no_embedding("k", "n"), rq._best_embedding("n", "b"), rq._weak("b", "w", _SOFT), rq._one("w", "o"), rq._per_target("o", "t", _SOFT), rq._tie("t", "x", _SOFT))
_HEAD = ["Application Name:\ttermweave", "Version:\t2.0", "Run at:\t00:00.00, 01.01.25", "Run from:\tlocal", "", "", "\t".join(responses.REPORT_COLUMNS)]

SQL = {
    "service_map": f"{_evidence(_SOFT, False)},\n" + ",\n".join(_RULES) + f"\nSELECT prop_id, {_RANKED} AS place, term_id, round(x.confidence, 6) AS confidence, kind FROM x",
    "service_report": f"{_evidence(Filter(), True)},\n"
    + ",\n".join((rq._C, rq._corroborate("c", "k"), rq._one("k", "x")))
    + f""",
r AS (SELECT *, {_RANKED} - 1 AS place FROM x)
SELECT prop_id, place, concat_ws(chr(9), coalesce(property_type, ''), coalesce(text, ''), coalesce(label, ''), CASE WHEN confidence >= 0.9 THEN 'High' WHEN confidence >= 0.7 THEN 'Good' WHEN confidence >= 0.5 THEN 'Medium' ELSE 'Low' END, term_id, coalesce(ontology, ''), coalesce(datasource, ''), '{responses.NO_STUDY}') AS line FROM r WHERE term_id IS NOT NULL
UNION ALL SELECT -1, i - 1, [{', '.join("'" + h + "'" for h in _HEAD)}][i] FROM range(1, {len(_HEAD) + 1}) t(i)""",
}
