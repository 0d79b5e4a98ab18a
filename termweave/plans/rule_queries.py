"""Queries over the rules, each with its SQL twin on the same evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions import evidence as ev
from termweave.functions import ids
from termweave.operators import rules
from termweave.plans.filters import Filter
from termweave.session import table
from termweave.skew import ordered_positions
from termweave.sources.adapter import EVIDENCE_SQL, evidence

HARD = Filter(targets=("dizo", "phexo", "chemix"), include_other=False)
SOFT = Filter(targets=("dizo", "phexo"))
DEFINING = Filter(targets=("dizo", "anax"), defining_only=True)
FULL = Filter(required=("curated-a", "atlasx"), preferred=("atlasx", "phexo"), targets=("dizo", "phexo", "chemix"), include_other=False)
EXCLUDED = ["DIZO_0001682", "http://terms.example/phexo/PHEXO_0001351", "chemix_0002207"]

# ---- SQL ----

_TIERS = {t: (i, c, full) for i, (t, c, full) in enumerate(ev.TIERS)}
_case = lambda col, d: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.items()) + " END"
_METHOD = _case("kind", {k: f"'{m}'" for k, m in ev.METHODS.items()})
_TIER = _case("kind", {k: f"'{t}'" for k, t in ev.KINDS.items()})
_CAP = _case("tier", {t: c for t, (_, c, _) in _TIERS.items()})
_RANK = _case("tier", {t: i * 2 for t, (i, _, _) in _TIERS.items()}) + " + CASE WHEN kind LIKE 'OLS_LEXICAL%' THEN 1 ELSE 0 END"
_FULL = "tier IN (" + ", ".join(f"'{t}'" for t, (_, _, f) in _TIERS.items() if f) + ")"
_PREFIX = "CASE WHEN strpos(term_id, '_') > 1 THEN lower(split_part(term_id, '_', 1)) END"
_list = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _target(targets) -> str:
    t = _list(targets)
    return f"CASE WHEN {_PREFIX} IN {t} THEN {_PREFIX} WHEN lower(ontology) IN {t} THEN lower(ontology) END"


def _classified(source: str, out: str) -> str:
    return f"""{out}0 AS (SELECT *, {_METHOD} AS method, {_TIER} AS tier, coalesce(iri, term_id) AS term_key FROM {source}),
{out} AS (SELECT *, {_RANK} AS rank FROM {out}0)"""


_ORDER = "confidence DESC, rank, seq"
_FORMS = "[lower(term_id), lower(iri), lower(regexp_extract(iri, '([^/#]*)$', 1))]"


def _exclude(source: str, out: str) -> str:
    forms = sorted({f for x in EXCLUDED for f in (x.lower(), x.lower().rsplit("/", 1)[-1])})
    return f"{out} AS (SELECT * FROM {source} WHERE NOT list_has_any({_FORMS}, [{', '.join(repr(f) for f in forms)}]))"


def _required(source: str, out: str, required) -> str:
    return f"{out} AS (SELECT * FROM {source} WHERE coalesce({_METHOD} <> 'curated' OR lower(datasource) IN {_list(required)}, false))"


def _hard(source: str, out: str, targets) -> str:
    return f"{out} AS (SELECT * FROM {source} WHERE ({_target(targets)}) IS NOT NULL)"


_PRIORS = """pri AS (SELECT list_distinct(string_split(trim(regexp_replace(lower(type_name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS words,
  list_transform(namespaces, lambda x: lower(x)) AS spaces, coalesce(excluded, []) AS excluded FROM property_types),
typ AS (SELECT property_type, list_distinct(flatten(list(spaces))) AS spaces FROM (
  SELECT DISTINCT property_type, list_distinct(string_split(trim(regexp_replace(lower(property_type), '[^a-z0-9]+', ' ', 'g')), ' ')) AS w FROM ev WHERE property_type IS NOT NULL)
  JOIN pri ON list_has_all(w, pri.words) AND NOT list_has_any(w, pri.excluded) GROUP BY property_type)"""


def _prior(source: str, out: str) -> str:
    return f"""{_PRIORS}, {out}0 AS (SELECT s.*, coalesce(list_has_any([lower(ontology), {_PREFIX}], spaces), false) AS inside FROM {source} s LEFT JOIN typ USING (property_type)),
{out}1 AS (SELECT *, bool_or(inside AND {_FULL}) OVER (PARTITION BY prop_id) AS grounded FROM {out}0),
{out} AS (SELECT * EXCLUDE (inside, grounded) REPLACE (CASE WHEN NOT grounded THEN confidence WHEN inside AND {_FULL} THEN least(1.0, confidence + 0.1)
  WHEN NOT inside THEN greatest(0.0, confidence - 0.1) ELSE confidence END AS confidence) FROM {out}1)"""


def _corroborate(source: str, out: str) -> str:
    return f"""{out}0 AS (SELECT *, method || ':' || kind AS channel, method || ':' || kind || '=' || coalesce(label, '') || '>' || coalesce(iri, '') AS note,
  row_number() OVER (PARTITION BY prop_id, term_key ORDER BY {_ORDER}) AS rn FROM {source}),
{out}c AS (SELECT prop_id, term_key, channel, min(seq) FILTER (confidence >= 0.5) AS first, arg_min(note, seq) FILTER (confidence >= 0.5) AS note, bool_or(rn = 1) AS won FROM {out}0 GROUP BY ALL),
{out}g AS (SELECT prop_id, term_key, string_agg(note, ' | ' ORDER BY first) AS sup, count(*) AS n FROM {out}c WHERE NOT won AND first IS NOT NULL GROUP BY ALL),
{out}1 AS (SELECT a.*, sup, coalesce(n, 0) AS n FROM {out}0 a LEFT JOIN {out}g g ON a.prop_id = g.prop_id AND a.term_key = g.term_key),
{out} AS (SELECT * EXCLUDE (channel, note, rn, sup, n) REPLACE (CASE WHEN rn = 1 AND n > 0
  THEN least(greatest({_CAP}, confidence), confidence + n * 0.02) ELSE confidence END AS confidence),
  CASE WHEN rn = 1 AND n > 0 THEN sup END AS supporting FROM {out}1)"""


def _no_embedding(source: str, out: str) -> str:
    return f"""{out}0 AS (SELECT *, bool_or(tier = 'CURATED_FULL') OVER (PARTITION BY prop_id) AS exact FROM {source}),
{out} AS (SELECT * EXCLUDE (exact) FROM {out}0 WHERE NOT (exact AND method = 'semantic'))"""


def _best_embedding(source: str, out: str) -> str:
    return f"""{out}0 AS (SELECT *, max(CASE WHEN method = 'semantic' THEN confidence END) OVER (PARTITION BY prop_id) AS top FROM {source}),
{out} AS (SELECT * EXCLUDE (top) FROM {out}0 WHERE NOT coalesce(method = 'semantic' AND top > 0 AND confidence < top - 0.005, false))"""


def _weak(source: str, out: str, f: Filter) -> str:
    t = _target(f.targets) if f.targets else "CAST(NULL AS VARCHAR)"
    start = f"""{out}0 AS (SELECT *, {t} AS tgt FROM {source}),
{out}1 AS (SELECT *, greatest(0.0, max(confidence) OVER (PARTITION BY prop_id)) AS best, max(confidence) OVER (PARTITION BY prop_id, tgt) AS own,
  max(CASE WHEN tgt IS NOT NULL THEN confidence END) OVER (PARTITION BY prop_id) AS besttarget FROM {out}0)"""
    low = "(best >= 0.7 AND confidence < best - 0.2)"
    if f.hard:
        drop = f"({low} AND NOT (tgt IS NOT NULL AND confidence >= own)) OR (tgt IS NOT NULL AND confidence < own - 0.05)"
    elif f.targets:
        drop = f"{low} OR (tgt IS NULL AND coalesce(besttarget >= confidence - 0.05, false))"
    else:
        drop = low
    return f"{start},\n{out} AS (SELECT * EXCLUDE (tgt, best, own, besttarget) FROM {out}1 WHERE NOT ({drop}))"


def _one(source: str, out: str) -> str:
    return f"""{out}0 AS (SELECT *, row_number() OVER (PARTITION BY prop_id, term_key ORDER BY {_ORDER}) AS rn, min(seq) OVER (PARTITION BY prop_id, term_key) AS pos FROM {source} WHERE term_key IS NOT NULL),
{out} AS (SELECT * EXCLUDE (rn) FROM {out}0 WHERE rn = 1)"""


def _per_target(source: str, out: str, f: Filter) -> str:
    return f"""{out}0 AS (SELECT *, {_target(f.targets)} AS tgt FROM {source}),
{out}1 AS (SELECT *, max(confidence) OVER (PARTITION BY prop_id, tgt) AS top FROM {out}0),
{out} AS (SELECT * EXCLUDE (tgt, top) FROM {out}1 WHERE tgt IS NULL OR confidence >= top)"""


def _tie(source: str, out: str, f: Filter) -> str:
    place = _case("tgt", {t: i for i, t in enumerate(f.targets)})
    return f"""{out}0 AS (SELECT *, {_target(f.targets)} AS tgt FROM {source}), {out}1 AS (SELECT *, {place} AS prio FROM {out}0),
{out}2 AS (SELECT *, max(CASE WHEN prio IS NOT NULL THEN confidence END) OVER (PARTITION BY prop_id ORDER BY coalesce(prio, 1000) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM {out}1),
{out} AS (SELECT * EXCLUDE (tgt, prio, ahead) FROM {out}2 WHERE NOT coalesce(prio IS NOT NULL AND ahead >= confidence, false))"""


def _preferred(source: str, out: str, f: Filter) -> str:
    p = _list(f.preferred)
    return f"{out} AS (SELECT *, CASE WHEN lower(datasource) IN {p} OR lower(ontology) IN {p} OR {_PREFIX} IN {p} THEN true END AS preferred FROM {source})"


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join((EVIDENCE_SQL, *ctes)) + f"\n{select}"


_OUT = "SELECT prop_id, seq, term_id, round(confidence, 6) AS confidence"


def _out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("prop_id", "seq", "term_id", F.round("confidence", 6).alias("confidence"), *more)


def _rule(rule):
    """A query of one rule on the classified evidence."""
    return lambda spark, sf_dir: _out(rule(rules.classify(evidence(spark, sf_dir))))


def _priors(spark, sf_dir: str) -> list:
    return rules.read_priors(table(spark, sf_dir, "property_types"))


def property_type_prior(spark, sf_dir: str) -> DataFrame:
    return _out(rules.type_prior(rules.classify(evidence(spark, sf_dir)), _priors(spark, sf_dir)))


def corroboration(spark, sf_dir: str) -> DataFrame:
    e = rules.corroborate(rules.classify(evidence(spark, sf_dir)))
    note = lambda c: F.concat(c[0]["method"], F.lit(":"), c[0]["matchType"], F.lit("="), F.coalesce(c[0]["matchedText"], F.lit("")), F.lit(">"), F.coalesce(c[0]["target"], F.lit("")))
    return _out(e.withColumn("supporting", F.array_join(F.transform("supporting", note), " | ")), "supporting")


def dedup_by_term(spark, sf_dir: str) -> DataFrame:
    return _out(rules.one_per_term(rules.classify(evidence(spark, sf_dir))), "pos")


def rank_all(spark, sf_dir: str) -> DataFrame:
    """All results of each property in rank order (W1 has no limit)."""
    e = rules.mark_preferred(rules.one_per_term(rules.classify(evidence(spark, sf_dir))), FULL.preferred).select("prop_id", "seq", "term_id", "confidence", "preferred", "rank", "pos")
    return _out(ordered_positions(e, "prop_id", rules.ranking()), "place")


def escalation(spark, sf_dir: str) -> DataFrame:
    return rules.needs_deep(evidence(spark, sf_dir), DEFINING, None, EXCLUDED)


def map_full(spark, sf_dir: str) -> DataFrame:
    return _out(rules.reduce_full(evidence(spark, sf_dir), FULL, EXCLUDED, _priors(spark, sf_dir)), "pos", "preferred")


def map_light(spark, sf_dir: str) -> DataFrame:
    return _out(rules.reduce_light(evidence(spark, sf_dir), FULL, EXCLUDED, _priors(spark, sf_dir)), "pos", "preferred")


def evidence_tiers(spark, sf_dir: str) -> DataFrame:
    e = rules.classify(evidence(spark, sf_dir))
    return e.select("prop_id", "seq", "method", "tier", "rank", F.round(ev.tier_confidence(F.col("tier"), F.col("confidence")), 6).alias("worth"), ev.level(F.col("confidence"), F.col("tier")).alias("level"))


def term_identity(spark, sf_dir: str) -> DataFrame:
    """Namespace, membership and comparison forms of every candidate."""
    e = evidence(spark, sf_dir)
    forms = F.array_join(F.array_sort(F.array_distinct(ids.comparison_forms(F.col("term_id"), F.col("iri")))), " ")
    member = F.array_join(F.array_sort(ids.memberships(F.col("ontology"), F.col("term_id"))), " ")
    return e.select("seq", ids.prefix_of(F.col("iri")).alias("prefix"), member.alias("member"), forms.alias("forms"), ids.compact(F.col("term_id")).alias("compact"))


_C = _classified("ev", "c")
QUERIES = {
    "exclude_terms": _rule(lambda e: rules.exclude_terms(e, EXCLUDED)),
    "required_sources": _rule(lambda e: rules.required_sources(e, FULL.required)),
    "ontology_hard_filter": _rule(lambda e: rules.hard_ontologies(e, HARD)),
    "defining_only": _rule(lambda e: rules.defining_only(e, DEFINING)),
    "property_type_prior": property_type_prior,
    "corroboration": corroboration,
    "suppress_embedding": _rule(rules.suppress_embedding),
    "best_embedding": _rule(rules.best_embedding),
    "weak_floor": _rule(lambda e: rules.prune_weak(e, Filter())),
    "weak_hard": _rule(lambda e: rules.prune_weak(e, HARD)),
    "weak_soft": _rule(lambda e: rules.prune_weak(e, SOFT)),
    "dedup_by_term": dedup_by_term,
    "best_per_target": _rule(lambda e: rules.best_per_target(e, HARD)),
    "priority_tie": _rule(lambda e: rules.higher_priority_on_tie(e, HARD)),
    "rank_all": rank_all,
    "escalation": escalation,
    "map_full": map_full,
    "map_light": map_light,
    "evidence_tiers": evidence_tiers,
    "term_identity": term_identity,
}

_SHARED = (_exclude("ev", "x"), _required("x", "r", FULL.required), _hard("r", "h", FULL.targets), _classified("h", "c"), _prior("c", "p"), _corroborate("p", "k"))
SQL = {
    "exclude_terms": _with(_exclude("ev", "x"), select=f"{_OUT} FROM x"),
    "required_sources": _with(_required("ev", "x", FULL.required), select=f"{_OUT} FROM x"),
    "ontology_hard_filter": _with(_hard("ev", "x", HARD.targets), select=f"{_OUT} FROM x"),
    "defining_only": _with(select=f"{_OUT} FROM ev WHERE coalesce({_PREFIX}, lower(ontology)) IN {_list(DEFINING.targets)}"),
    "property_type_prior": _with(_C, _prior("c", "p"), select=f"{_OUT} FROM p"),
    "corroboration": _with(_C, _corroborate("c", "k"), select=f"{_OUT}, supporting FROM k"),
    "suppress_embedding": _with(_C, _no_embedding("c", "n"), select=f"{_OUT} FROM n"),
    "best_embedding": _with(_C, _best_embedding("c", "n"), select=f"{_OUT} FROM n"),
    "weak_floor": _with(_C, _weak("c", "w", Filter()), select=f"{_OUT} FROM w"),
    "weak_hard": _with(_C, _weak("c", "w", HARD), select=f"{_OUT} FROM w"),
    "weak_soft": _with(_C, _weak("c", "w", SOFT), select=f"{_OUT} FROM w"),
    "dedup_by_term": _with(_C, _one("c", "o"), select=f"{_OUT}, pos FROM o"),
    "best_per_target": _with(_C, _per_target("c", "o", HARD), select=f"{_OUT} FROM o"),
    "priority_tie": _with(_C, _tie("c", "o", HARD), select=f"{_OUT} FROM o"),
    "rank_all": _with(_C, _one("c", "o"), _preferred("o", "q", FULL), select=f"{_OUT}, row_number() OVER (PARTITION BY prop_id ORDER BY q.confidence DESC, coalesce(preferred, false) DESC, rank, pos) AS place FROM q"),
    "escalation": _with(
        _exclude("ev", "x"),
        select=f"SELECT DISTINCT prop_id FROM ev WHERE prop_id NOT IN (SELECT prop_id FROM x WHERE confidence >= 0.7 AND ({_target(DEFINING.targets)}) IS NOT NULL AND coalesce({_PREFIX} IN {_list(DEFINING.targets)}, true))",
    ),
    "map_full": _with(*_SHARED, _no_embedding("k", "n"), _best_embedding("n", "b"), _weak("b", "w", FULL), _one("w", "o"), _per_target("o", "t", FULL), _tie("t", "i", FULL), _preferred("i", "q", FULL), select=f"{_OUT}, pos, preferred FROM q"),
    "map_light": _with(*_SHARED, _one("k", "o"), _preferred("o", "q", FULL), select=f"{_OUT}, pos, preferred FROM q"),
    "evidence_tiers": _with(
        _C,
        select=f"""SELECT prop_id, seq, method, tier, rank, round(CASE WHEN {_FULL} THEN {_CAP} ELSE confidence * {_CAP} END, 6) AS worth,
  CASE WHEN {_FULL} OR confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'GOOD' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM c""",
    ),
    "term_identity": _with(
        select=f"""SELECT seq, lower(split_part(regexp_extract(iri, '([^/#]*)$', 1), '_', 1)) AS prefix,
  array_to_string(list_sort(list_distinct([lower(ontology), {_PREFIX}])), ' ') AS member, array_to_string(list_sort(list_distinct({_FORMS})), ' ') AS forms,
  regexp_replace(term_id, '^([^_]+)_', '\\1:') AS compact FROM ev"""
    ),
}
