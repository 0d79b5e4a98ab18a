"""Queries over searching, settling and expanding, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions import evidence as ev
from termweave.functions import similarity as sim
from termweave.functions import variants as var
from termweave.operators import search
from termweave.plans import service
from termweave.plans.filters import Filter
from termweave.session import cut_lineage, table
from termweave.sources import adapter
from termweave.sources.adapter import NAMES_SQL, properties, terms

MODEL = "zm-small-v1"
SCOPED = Filter(targets=("chemix", "phexo"), include_other=False, defining_only=True)
SOFT = Filter(targets=("dizo", "phexo"))
AWAY = Filter(targets=("celux", "trox", "xr"))
#: Vectors that are looked up: the stated queries, every id that is divisible by this.
STATED = 50


def _texts(spark, sf_dir: str) -> DataFrame:
    return properties(spark, sf_dir).select("text").distinct()


def _round(c: str = "confidence", n: int = 6):
    return F.round(c, n).alias(c)


def lexical_search(spark, sf_dir: str) -> DataFrame:
    """Search by words and spelling for every text, over all terms."""
    return search.lexical(_texts(spark, sf_dir), terms(spark, sf_dir)).select("text", "iri", "kind", "matched", _round())


def lexical_scoped(spark, sf_dir: str) -> DataFrame:
    """The same within the targets alone, containment scored against their own terms."""
    return search.lexical(_texts(spark, sf_dir), terms(spark, sf_dir), SCOPED).select("text", "iri", "kind", _round())


def lexical_soft(spark, sf_dir: str) -> DataFrame:
    """The same over all terms and within the targets, merged."""
    return search.lexical(_texts(spark, sf_dir), terms(spark, sf_dir), SOFT, 5).select("text", "iri", "kind", _round())


def _tags(spark, sf_dir: str) -> DataFrame:
    return service.tagged(cut_lineage(_texts(spark, sf_dir)), service.vocabulary(spark, sf_dir))


def tagged_evidence(spark, sf_dir: str) -> DataFrame:
    """What dictionaries find in every text: curated strings, names, and names of spelling variants, with the text that was tagged."""
    return _tags(spark, sf_dir).select("text", "iri", "kind", "channel", F.col("chain")[0]["input"].alias("input"), "datasource", _round())


EXCLUDED = ["DIZO_0001682", "http://terms.example/phexo/PHEXO_0001351", "chemix_0002207", "GENIX_0001021"]


def settled_texts(spark, sf_dir: str) -> DataFrame:
    """The texts that tagging settles under three requests: any definitive hit, one from a target and its namespace, any that is not excluded."""
    tags = cut_lineage(_tags(spark, sf_dir))
    out = service.settled(tags).withColumn("request", F.lit("any"))
    own = service.settled(tags, Filter(targets=("dizo", "genix"), defining_only=True)).withColumn("request", F.lit("targets"))
    return out.unionByName(own).unionByName(service.settled(tags, Filter(), EXCLUDED).withColumn("request", F.lit("excluded")))


def _vectors(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts of the stated query vectors, and the two tables of vectors."""
    asked, known = adapter.vectors(spark, sf_dir, MODEL)
    asked = cut_lineage(asked.filter(F.col("id") % STATED == 0))
    return asked.select("text").distinct(), asked, cut_lineage(known)


def vector_hits(spark, sf_dir: str) -> DataFrame:
    """Vector search for every stated text, over all terms and within each target, merged by term."""
    hits = search.by_vectors(*_vectors(spark, sf_dir), SOFT)
    return hits.select("text", "iri", _round("score"), F.round(ev.tier_confidence(F.lit("EMBEDDING"), F.col("score")), 6).alias("confidence"))


def merged_hits(spark, sf_dir: str) -> DataFrame:
    """Hits of several searches merged: each model's candidates of a query stand for one search, confidence for its score."""
    c = table(spark, sf_dir, "candidates").filter("query_key is not null")
    hits = c.select(F.col("query_key").alias("text"), F.col("uri").alias("iri"), F.col("confidence").alias("score"), (F.col("cand_id") % 7).alias("turn"))
    return search.merged_hits(hits).select("text", "iri", _round("score"), "turn")


def vector_unseen(spark, sf_dir: str) -> DataFrame:
    """What the deep search adds to the shallow one."""
    given = _vectors(spark, sf_dir)
    shallow = cut_lineage(search.by_vectors(*given))
    return search.unseen(search.by_vectors(*given, k=search.DEEP), shallow).select("text", "iri", _round("score"))


def _seeds(spark, sf_dir: str, v: service.Vocabulary) -> DataFrame:
    """Evidence of words whose term's own vector (the smallest id) is a stated query."""
    found = search.lexical(_texts(spark, sf_dir), v.terms, Filter(), 3)
    stated = v.term_vectors.groupBy("iri").agg(F.min("id").alias("own")).filter(F.col("own") % STATED == 0)
    rows = found.join(stated, "iri", "left_semi").join(v.terms.select("iri", "label"), "iri").withColumn("channel", F.lit(1)).withColumn("datasource", F.col("ontology"))
    return cut_lineage(service.placed(rows.withColumn("chain", F.array(ev.lexical_step(F.col("ontology"), F.col("kind"), F.col("text"), F.col("label"), F.col("iri"), F.col("confidence"))))))


def similar_in_mapper(spark, sf_dir: str) -> DataFrame:
    """Terms of the targets near those that searching found, for the texts that no target's source answers."""
    v = service.vocabulary(spark, sf_dir, MODEL)
    return service.near_evidence(_seeds(spark, sf_dir, v), v, AWAY).select("text", "iri", "kind", _round(), F.size("chain").alias("steps"), F.col("chain")[1]["input"].alias("seed"))


def xref_in_mapper(spark, sf_dir: str) -> DataFrame:
    """What cross-references lead to in the targets, for the texts whose evidence has no target's namespace; unknown targets keep their id and take the text for a label."""
    v = service.vocabulary(spark, sf_dir)
    found = search.lexical(_texts(spark, sf_dir), v.terms, Filter(), 3).join(v.terms.select("iri", "label"), "iri").withColumn("channel", F.lit(1)).withColumn("datasource", F.col("ontology"))
    rows = found.withColumn("chain", F.array(ev.lexical_step(F.col("ontology"), F.col("kind"), F.col("text"), F.col("label"), F.col("iri"), F.col("confidence"))))
    out = service.xref_evidence(cut_lineage(service.placed(rows)), v, AWAY)
    return out.select("text", F.col("chain")[0]["target"].alias("seed"), "iri", "term_id", "label", "datasource", _round(), F.col("chain")[1]["matchedText"].alias("step"))


def replaced_evidence(spark, sf_dir: str) -> DataFrame:
    """Evidence of candidates with obsolete terms exchanged, and the last step of each chain."""
    v = service.vocabulary(spark, sf_dir)
    e = adapter.evidence(spark, sf_dir).withColumnRenamed("prop_id", "text").withColumn("chain", F.array(ev.step("lexical", F.col("kind"))))
    out = service.live(e, v)
    return out.select("seq", "iri", "term_id", F.size("chain").alias("steps"), F.element_at("chain", -1)["matchedText"].alias("last"))


QUERIES = {
    f.__name__: f
    for f in (
        lexical_search, lexical_scoped, lexical_soft, tagged_evidence, settled_texts, vector_hits, merged_hits, vector_unseen, similar_in_mapper, xref_in_mapper, replaced_evidence,
    )
}

# ---- SQL ----

_TEXTS = "texts AS (SELECT DISTINCT propertyValue AS text FROM text_to_map WHERE trim(propertyValue) <> '')"
_STOP = "[" + ", ".join(f"'{w}'" for w in sim.STOPWORDS) + "]"
_TOK = lambda c: f"list_distinct(list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"
_CON = lambda c: f"list_filter({_TOK(c)}, lambda w: NOT list_contains({_STOP}, w))"
_FOLD = lambda c: f"regexp_replace(trim(lower(coalesce({c}, ''))), '\\s+', ' ', 'g')"
_GRAMS = lambda c: f"list_distinct(list_filter(list_transform(range(1, greatest(length({c}) - 2, 1) + 1), lambda i: substr({c}, i, 3)), lambda g: g <> ''))"
#: Every character of two texts stands for one byte, as the SQL engine counts edits in bytes.
BYTES = "array_to_string(list_transform(range(33, 127), lambda i: chr(CAST(i AS INTEGER))), '')"


def edit_sql(a: str, b: str) -> str:
    """Edit similarity of two folded texts, counted in characters."""
    u = f"array_to_string(list_distinct(string_split({a} || {b}, '')), '')"
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 1.0 - levenshtein(translate({a}, {u}, {BYTES}), translate({b}, {u}, {BYTES})) / greatest(length({a}), length({b})) END"


def _common(left: str, right: str, column: str, least: float) -> str:
    return f"""SELECT l, r FROM (SELECT l, r, count(*) AS k, any_value(n) AS n, any_value(m) AS m FROM (SELECT text AS l, len({column}) AS n, unnest({column}) AS w FROM {left}) JOIN (SELECT name AS r, len({column}) AS m, unnest({column}) AS w FROM {right}) USING (w) GROUP BY l, r)
  WHERE k / (n + m - k) >= {least} - 1e-9"""


#: found: text, iri, short_form, ontology, same, n, held, score, bname for every pair that any join finds.
FOUND_SQL = f"""{NAMES_SQL}, {_TEXTS},
nt AS (SELECT iri, short_form, ontology_name AS ontology, ord, name, lower(name) AS low FROM names JOIN ols_terms USING (iri)),
q AS (SELECT *, {_GRAMS('f')} AS t FROM (SELECT text, lower(text) AS low, {_TOK('text')} AS g, {_CON('text')} AS c, {_FOLD('text')} AS f FROM texts)),
d AS (SELECT *, {_GRAMS('f')} AS t FROM (SELECT name, {_TOK('name')} AS g, {_CON('name')} AS c, {_FOLD('name')} AS f FROM (SELECT DISTINCT name FROM names))),
holds AS (SELECT text, name, len(b.c) AS n FROM q JOIN (SELECT *, unnest(c) AS w FROM d) b ON q.c[1] = b.w AND list_has_all(b.c, q.c)),
pair AS (SELECT text, iri FROM q JOIN nt USING (low) UNION SELECT text, iri FROM holds JOIN nt USING (name)
  UNION SELECT l, iri FROM ({_common('q', 'd', 'g', search.LEAST_WORDS)}) JOIN nt ON nt.name = r UNION SELECT l, iri FROM ({_common('q', 'd', 't', search.LEAST_TRIGRAMS)}) JOIN nt ON nt.name = r),
each AS (SELECT text, iri, short_form, ontology, ord, name, CASE WHEN q.low = nt.low THEN CASE WHEN ord = 0 THEN 2 ELSE 1 END ELSE 0 END AS same, q.f AS a, d.f AS b, q.g AS ga, d.g AS gb
  FROM pair JOIN q USING (text) JOIN nt USING (iri) JOIN d USING (name)),
like0 AS (SELECT *, greatest({edit_sql('a', 'b')}, CASE WHEN len(ga) = 0 AND len(gb) = 0 THEN 1.0 WHEN len(ga) = 0 OR len(gb) = 0 THEN 0.0 ELSE len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))) END) AS s FROM each),
found AS (SELECT text, iri, short_form, ontology, max(same) AS same, min(n) AS n, arg_min(e.name, {{'n': n, 'o': ord, 'm': e.name}}) FILTER (n IS NOT NULL) AS held, max(s) AS score, arg_max(e.name, {{'s': s, 'o': -ord, 'm': e.name}}) AS bname
  FROM like0 e LEFT JOIN holds h USING (text, name) GROUP BY ALL)"""


def lexical_sql(f: Filter, k: int, matched: bool = False) -> str:
    targets = "(" + ", ".join(f"'{t}'" for t in f.targets) + ")"
    inside = f"coalesce(lower(ontology) IN {targets}, false)" if f.targets else "false"
    order = "same DESC, CASE WHEN same = 0 THEN n END NULLS LAST, round(score, 9) DESC, iri"
    keep = f"(ins AND p2 <= {k})" if f.hard else f"(p1 <= {k} OR (ins AND p2 <= {k}))" if f.targets else f"p1 <= {k}"
    own = f"split_part(lower(short_form), '_', 1) IN {targets}" if f.defining_only else "true"
    extra = ", CASE WHEN kind = 'OLS_LEXICAL_CONTAINED' THEN held ELSE bname END AS matched" if matched else ""
    return f"""{FOUND_SQL}, r0 AS (SELECT *, {inside} AS ins FROM found),
r1 AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY {order}) AS p1, row_number() OVER (PARTITION BY text, ins ORDER BY {order}) AS p2 FROM r0),
r2 AS (SELECT *, coalesce(min(CASE WHEN {own} THEN n END) OVER (PARTITION BY text), min(n) OVER (PARTITION BY text)) AS least,
  CASE WHEN same = 2 THEN 'OLS_LEXICAL_FUZZY_LABEL' WHEN same = 1 THEN 'OLS_LEXICAL_FUZZY_SYNONYM' WHEN n IS NOT NULL THEN 'OLS_LEXICAL_CONTAINED' ELSE 'OLS_LEXICAL_FUZZY' END AS kind FROM r1 WHERE {keep}),
lex AS (SELECT text, iri, short_form, ontology, kind{extra}, CASE same WHEN 2 THEN 1.0 WHEN 1 THEN 0.9 ELSE CASE WHEN n IS NULL THEN 0.7 * score WHEN n <= least THEN 0.89 ELSE 0.89 * (0.5 + 0.5 * least / n) END END AS confidence FROM r2)"""


_sl = lambda xs: "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"
_map = lambda pairs: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs) + "}"
_spaced = lambda c: f"trim(regexp_replace(trim({c}), '\\s+', ' ', 'g'))"


def _number_sql() -> str:
    pairs = list(zip(var.IRREGULAR[0::2], var.IRREGULAR[1::2]))
    other = {k: v for a, b in pairs for k, v in ((a, b), (b, a))}
    ends = {e: f"{cut}|{add}" for e, cut, add in var.NUMBER_ENDINGS}
    rule = "coalesce(" + ", ".join(f"element_at({_map(ends.items())}, right(lower(word), {n}))[1]" for n in range(4, 0, -1)) + ", '0|s')"
    return f"""CASE WHEN length(word) < 4 OR NOT regexp_full_match(word, '\\p{{L}}+') OR lower(word) IN {_sl(var.INVARIANT)} OR contains(head, '.') THEN base
  WHEN irr IS NOT NULL THEN head || CASE WHEN regexp_matches(word, '^\\p{{Lu}}') THEN upper(irr[1]) || substr(irr, 2) ELSE irr END
  ELSE head || substr(word, 1, length(word) - CAST(split_part(rule, '|', 1) AS INTEGER)) || split_part(rule, '|', 2) END""", f"element_at({_map(other.items())}, lower(word))[1]", rule


def _greek_sql(source: str) -> str:
    for g, name in var.GREEK:
        source = f"(SELECT * REPLACE (CASE WHEN contains(gr, '{g}') THEN replace(gr, '{g}', '{name}') ELSE regexp_replace(gr, '(?i)\\b{name}\\b', '{g}', 'g') END AS gr) FROM {source})"
    return source


def _spelling_sql() -> str:
    cases = []
    for pair in var.SPELLING:
        for a, b in (pair, pair[::-1]):
            if "$1" not in a:
                new = b.replace("\\b", "").replace("$1", "\\1")
                cases.append(f"WHEN regexp_matches(base, '(?i){a}') THEN regexp_replace(base, '(?i){a}', '{new}', 'g')")
    return "CASE " + " ".join(cases) + " ELSE base END"


def _numeral_sql() -> str:
    words = "type|grade|stage|class|phase|group|level"
    roman = f"(?is)^(.*?\\b(?:{words})\\s+)(i|ii|iii|iv|v|vi|vii|viii|ix|x)\\b(.*)$"
    arabic = f"(?is)^(.*?\\b(?:{words})\\s+)([1-9]|10)\\b(.*)$"
    to_a, to_r = _map((r, i + 1) for i, r in enumerate(var.ROMAN)), _map((i + 1, r.upper()) for i, r in enumerate(var.ROMAN))
    put = lambda p, new: f"regexp_extract(base, '{p}', 1) || {new} || regexp_extract(base, '{p}', 3)"
    first, second = (f"regexp_extract(base, '{p}', 2)" for p in (roman, arabic))
    return f"CASE WHEN regexp_matches(base, '{roman}') THEN {put(roman, f'element_at({to_a}, lower({first}))[1]')} WHEN regexp_matches(base, '{arabic}') THEN {put(arabic, f'element_at({to_r}, {second})[1]')} ELSE base END"


def _variants_sql() -> str:
    number, irregular, rule = _number_sql()
    hyphen = f"""array_to_string(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN i = 1 THEN ws[1] WHEN (lower(ws[i - 1]) IN {_sl(var.HYPHEN_BEFORE)} OR lower(ws[i]) IN {_sl(var.HYPHEN_AFTER)})
  AND regexp_full_match(ws[i - 1], '\\p{{L}}+') AND regexp_full_match(ws[i], '\\p{{L}}+') THEN '-' || ws[i] ELSE ' ' || ws[i] END), '')"""
    symbol = "CASE WHEN regexp_full_match(base, '[A-Za-z]{1,6}-\\d+[A-Za-z]?') THEN replace(base, '-', '') ELSE regexp_replace(base, '^([A-Za-z]{2,6})(\\d+[A-Za-z]?)$', '\\1-\\2') END"
    bare = "regexp_replace(regexp_replace(base, '[,;:()\\[\\]\"''`]+', ' ', 'g'), '\\.$', '')"
    base = f"(SELECT text, base, base AS gr, string_split(base, ' ') AS ws, regexp_extract(base, '^(.* )?([^ ]*)$', 1) AS head, regexp_extract(base, '^(.* )?([^ ]*)$', 2) AS word FROM (SELECT text, {_spaced('text')} AS base FROM texts))"
    every = ", ".join(_spaced(x) for x in ("translate(base, '-_', '  ')", hyphen, symbol, bare, number, "gr", _spelling_sql(), _numeral_sql()))
    return f"""vr0 AS (SELECT *, {irregular} AS irr, {rule} AS rule FROM {_greek_sql(base)}),
vr1 AS (SELECT text, list_filter([{every}], lambda v: v <> '' AND v <> base) AS l FROM vr0),
vars AS (SELECT text, list_filter(l, lambda v, i: list_position(l, v) = i)[1:{var.MOST}] AS variants FROM vr1)"""


VARIANTS_SQL = _variants_sql()
_DELIMS = "' ,.;:!?' || chr(9) || chr(10) || '()[]{}\"''/\\-_'"
#: runs: text, start, raw of every run of words of a text.
RUNS_SQL = f"""tx AS (SELECT text, list_filter(range(0, length(text) + 2), lambda i: i = 0 OR i = length(text) + 1 OR contains({_DELIMS}, text[i])) AS cut FROM texts),
tw AS (SELECT text, cut, unnest(range(1, len(cut))) AS k FROM tx), tw2 AS (SELECT text, cut[k] AS s, unnest(list_slice(cut, k + 1, k + 40)) AS e FROM tw WHERE cut[k + 1] > cut[k] + 1),
runs AS (SELECT text, s AS start, substr(text, s + 1, e - s - 1) AS raw FROM tw2 WHERE NOT contains({_DELIMS}, text[e - 1]) AND e - s - 1 <= 120)"""
#: dict: surface, iri, short_form, label, ontology, string_type, source; curd: the same of curated strings.
DICT_SQL = f"""{NAMES_SQL}, dict AS (SELECT DISTINCT lower(name) AS surface, iri, short_form, label, ontology_name AS ontology, CASE WHEN ord = 0 THEN 'label' ELSE 'synonym' END AS string_type, ontology_name AS source FROM names JOIN ols_terms USING (iri) WHERE trim(lower(name)) <> ''),
curd AS (SELECT DISTINCT lower(text) AS surface, iri, short_form, label, ontology_name AS ontology, 'CURATION' AS string_type, 'votes' AS source FROM (
  SELECT property_value AS text, term_id FROM votes WHERE property_value IS NOT NULL AND term_id IS NOT NULL GROUP BY ALL HAVING sum(CASE WHEN vote = 'up' THEN 1 ELSE -1 END) > 0) JOIN ols_terms ON short_form = term_id WHERE trim(lower(text)) <> '')"""


def _hits_sql(entries: str, out: str) -> str:
    return f"""{out} AS (SELECT text, iri, -b.m / strlen(text) AS coverage, b.t AS string_type, b.l AS label, b.o AS ontology, b.f AS short_form, b.c AS source FROM (
  SELECT text, iri, min({{'m': -strlen(raw), 't': string_type, 's': start, 'l': label, 'o': ontology, 'f': short_form, 'c': source}}) AS b FROM runs JOIN {entries} ON lower(raw) = surface
  WHERE strlen(raw) >= greatest(2, least(6, length(text))) GROUP BY text, iri))"""


_KIND = """CASE WHEN coverage >= 1 AND string_type = 'CURATION' THEN 'CURATED_EXACT' WHEN coverage >= 1 AND string_type = 'synonym' THEN 'OLS_TEXT_TAGGER_SYNONYM' WHEN coverage >= 1 THEN 'OLS_TEXT_TAGGER'
  WHEN string_type = 'CURATION' THEN 'CURATED_SUBSTRING' ELSE 'OLS_TEXT_TAGGER_SUBSTRING' END"""
_WORTH = "CASE kind WHEN 'CURATED_EXACT' THEN CAST(1.0 AS DOUBLE) WHEN 'OLS_TEXT_TAGGER' THEN 1.0 WHEN 'OLS_TEXT_TAGGER_SYNONYM' THEN 0.9 ELSE 0.89 * coverage END"
TAGGED_SQL = f"""{DICT_SQL}, {_TEXTS}, {RUNS_SQL}, {_hits_sql('dict', 'hit')}, {_hits_sql('curd', 'chit')}, {VARIANTS_SQL},
vhit0 AS (SELECT text, unnest(variants) AS variant, unnest(range(1, len(variants) + 1)) AS ord FROM vars),
vhit AS (SELECT text, iri, b.t AS string_type, b.v AS variant, b.f AS short_form, b.c AS source FROM (SELECT text, iri, min({{'a': ord, 't': string_type, 'l': label, 'o': ontology, 'f': short_form, 'c': source, 'v': variant}}) AS b FROM vhit0 JOIN dict ON lower(variant) = surface GROUP BY text, iri)
  WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.text = vhit0.text AND h.iri = dict.iri)),
every AS (SELECT text, iri, short_form, source, coverage, string_type, 6 AS channel, text AS input, CAST(1.0 AS DOUBLE) AS discount FROM chit UNION ALL SELECT text, iri, short_form, source, coverage, string_type, 7, text, CAST(1.0 AS DOUBLE) FROM hit
  UNION ALL SELECT text, iri, short_form, source, CAST(1.0 AS DOUBLE), string_type, 8, variant, CAST(0.95 AS DOUBLE) FROM vhit),
tags AS (SELECT *, {_WORTH} * discount AS confidence FROM (SELECT *, {_KIND} AS kind FROM every))"""
TAGGED_SQL = TAGGED_SQL.replace("JOIN dict ON lower(variant) = surface GROUP BY text, iri)\n  WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.text = vhit0.text AND h.iri = dict.iri))", "JOIN dict ON lower(variant) = surface GROUP BY text, iri) z\n  WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.text = z.text AND h.iri = z.iri))")
_SETTLE = "kind IN ('CURATED_EXACT', 'OLS_TEXT_TAGGER')"
_GONE = sorted({f for x in EXCLUDED for f in (x.lower(), x.lower().rsplit("/", 1)[-1])})


def _vectors_sql() -> str:
    return f"""e AS (SELECT emb_id AS id, text, source_type, CAST(embedding AS DOUBLE[]) AS v FROM embedding_store WHERE model = '{MODEL}' AND embedding IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
tno AS (SELECT no, arg_min(iri, md5(iri)) AS iri, arg_min(ontology_name, md5(iri)) AS ontology FROM (SELECT *, CAST(regexp_extract(short_form, '[0-9]+$') AS BIGINT) AS no FROM ols_terms WHERE regexp_matches(short_form, '[0-9]+$')) GROUP BY no),
tv AS (SELECT id, iri, ontology, v FROM e JOIN tno ON no = id % 400 + 1000 WHERE source_type <> 'property'),
asked AS (SELECT id, text, v FROM e WHERE source_type = 'property' AND text IS NOT NULL AND id % {STATED} = 0)"""


def _near_sql(k: int, scope: str, call: int, out: str) -> str:
    return f"""{out} AS (SELECT text, iri, s AS score, turn * 100 + {call} AS turn FROM (SELECT q.text, q.turn, tv.iri, tv.id, round(list_cosine_similarity(q.v, tv.v), 9) AS s, row_number() OVER (PARTITION BY q.text, q.turn ORDER BY round(list_cosine_similarity(q.v, tv.v), 9) DESC, tv.id) AS n FROM qs q, tv WHERE {scope}) WHERE n <= {k})"""


def _merged_sql(k: int, scopes: list[str], out: str) -> str:
    parts = [_near_sql(k, s, i, f"{out}{i}") for i, s in enumerate(scopes)]
    union = " UNION ALL ".join(f"SELECT * FROM {out}{i}" for i in range(len(scopes)))
    return ",\n".join(parts) + f""", {out} AS (SELECT text, iri, score FROM (SELECT *, row_number() OVER (PARTITION BY text, iri ORDER BY score DESC, turn) AS n FROM ({union}) WHERE score >= {search.LEAST_VECTOR}) WHERE n = 1)"""


_QS = "qs AS (SELECT c.text, c.turn, a.v FROM (SELECT text, 0 AS turn, text AS casing FROM asked UNION ALL SELECT text, 1, lower(text) FROM asked WHERE lower(text) <> text) c JOIN asked a ON a.text = c.casing)"
_AWAY = _sl(AWAY.targets)
_XREFS = """xr AS (SELECT DISTINCT source_iri, target_id, target_iri, target_label FROM (
  SELECT a.iri AS source_iri, regexp_replace(b.short_form, '_', ':') AS target_id, a.term_replaced_by AS target_iri, b.label AS target_label FROM ols_terms a LEFT JOIN ols_terms b ON b.iri = a.term_replaced_by WHERE a.term_replaced_by IS NOT NULL
  UNION ALL SELECT iri, x, x, NULL FROM (SELECT iri, unnest(list_distinct(CAST(json_extract(term_json, '$.annotation.has_dbxref') AS VARCHAR[]))) AS x FROM ols_terms WHERE json_type(term_json, '$.annotation.has_dbxref') = 'ARRAY')))"""
_DEAD = "(coalesce(is_obsolete <> 0, false) OR coalesce(lower(label) LIKE 'obsolete%', false))"

SQL = {
    "lexical_search": f"WITH {lexical_sql(Filter(), search.LEXICAL, True)} SELECT text, iri, kind, matched, round(confidence, 6) AS confidence FROM lex",
    "lexical_scoped": f"WITH {lexical_sql(SCOPED, search.LEXICAL)} SELECT text, iri, kind, round(confidence, 6) AS confidence FROM lex",
    "lexical_soft": f"WITH {lexical_sql(SOFT, 5)} SELECT text, iri, kind, round(confidence, 6) AS confidence FROM lex",
    "tagged_evidence": f"WITH {TAGGED_SQL} SELECT text, iri, kind, channel, input, source AS datasource, round(confidence, 6) AS confidence FROM tags",
    "settled_texts": f"""WITH {TAGGED_SQL} SELECT DISTINCT text, 'any' AS request FROM tags WHERE {_SETTLE}
UNION ALL SELECT DISTINCT text, 'targets' FROM tags WHERE {_SETTLE} AND lower(source) IN ('dizo', 'genix') AND split_part(lower(short_form), '_', 1) IN ('dizo', 'genix')
UNION ALL SELECT DISTINCT text, 'excluded' FROM tags WHERE {_SETTLE} AND NOT list_has_any([lower(short_form), lower(iri), lower(regexp_extract(iri, '([^/#]*)$', 1))], [{', '.join(repr(x) for x in _GONE)}])""",
    "vector_hits": f"""WITH {_vectors_sql()}, {_QS}, {_merged_sql(search.SHALLOW, ['true', *(f"lower(tv.ontology) = '{t}'" for t in SOFT.targets)], 'm')} SELECT text, iri, round(score, 6) AS score, round(0.89 * score, 6) AS confidence FROM m""",
    "vector_unseen": f"""WITH {_vectors_sql()}, {_QS}, {_merged_sql(search.SHALLOW, ['true'], 'm')}, {_merged_sql(search.DEEP, ['true'], 'd')}
SELECT text, iri, round(d.score, 6) AS score FROM d LEFT JOIN m USING (text, iri) WHERE m.score IS NULL OR d.score > m.score""",
    "merged_hits": f"""WITH h AS (SELECT query_key AS text, uri AS iri, confidence AS score, cand_id % 7 AS turn FROM candidates WHERE query_key IS NOT NULL AND uri IS NOT NULL AND NOT isnan(confidence) AND confidence >= {search.LEAST_VECTOR})
SELECT text, iri, round(score, 6) AS score, turn FROM (SELECT *, row_number() OVER (PARTITION BY text, iri ORDER BY score DESC, turn) AS n FROM h) WHERE n = 1""",
    "similar_in_mapper": f"""WITH {lexical_sql(Filter(), 3)}, {_vectors_sql()}, own AS (SELECT iri, min(id) AS id FROM tv GROUP BY iri HAVING min(id) % {STATED} = 0),
seed AS (SELECT l.* FROM lex l JOIN own USING (iri)), open AS (SELECT text FROM seed GROUP BY text HAVING NOT bool_or(lower(ontology) IN {_AWAY})),
near AS (SELECT iri, other, max(s) AS s FROM (SELECT o.iri, b.iri AS other, round(list_cosine_similarity(a.v, b.v), 9) AS s, row_number() OVER (PARTITION BY o.iri ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.id) AS n
  FROM own o JOIN tv a ON a.id = o.id, tv b WHERE b.id <> o.id) WHERE n <= {search.SIMILAR} GROUP BY iri, other)
SELECT text, other AS iri, kind, round(confidence * 0.7 * s, 6) AS confidence, 2 AS steps, seed.iri AS seed FROM seed JOIN open USING (text) JOIN near USING (iri) JOIN ols_terms t ON t.iri = other
WHERE confidence > 0.7 AND s >= 0.7 AND other <> seed.iri AND lower(t.ontology_name) IN {_AWAY}""",
    "xref_in_mapper": f"""WITH {lexical_sql(Filter(), 3)}, {_XREFS}, open AS (SELECT text FROM lex GROUP BY text HAVING NOT bool_or(lower(split_part(regexp_extract(iri, '([^/#]*)$', 1), '_', 1)) IN {_AWAY}))
SELECT text, lex.iri AS seed, target_iri AS iri, coalesce(t.short_form, target_id) AS term_id, CASE WHEN t.iri IS NULL THEN text ELSE t.label END AS label, coalesce(t.ontology_name, lower(split_part(target_id, ':', 1))) AS datasource, round(confidence * 0.95, 6) AS confidence,
  coalesce(o.label, 'null') || ' ≈ ' || coalesce(t.label, target_label, 'null') || ' (distance=1)' AS step
FROM lex JOIN open USING (text) JOIN xr ON source_iri = lex.iri LEFT JOIN ols_terms t ON t.iri = target_iri JOIN ols_terms o ON o.iri = lex.iri WHERE lower(split_part(target_id, ':', 1)) IN {_AWAY}""",
    "replaced_evidence": f"""WITH RECURSIVE walk AS (SELECT iri AS origin, [iri] AS seen, term_replaced_by AS nxt, 0 AS hops, CAST(NULL AS VARCHAR) AS iri, true AS dead, label, CAST(NULL AS VARCHAR) AS last FROM ols_terms WHERE iri IS NOT NULL AND {_DEAD}
  UNION ALL SELECT origin, list_append(seen, t.iri), t.term_replaced_by, hops + 1, t.iri, (coalesce(t.is_obsolete <> 0, false) OR coalesce(lower(t.label) LIKE 'obsolete%', false)), t.label, coalesce(walk.label, 'null') || ' → ' || coalesce(t.label, 'null')
  FROM walk JOIN ols_terms t ON t.iri = walk.nxt WHERE walk.dead AND hops < 5 AND NOT list_contains(seen, walk.nxt)), {adapter.EVIDENCE_SQL},
done AS (SELECT * FROM walk WHERE NOT dead)
SELECT seq, coalesce(d.iri, ev.iri) AS iri, CASE WHEN d.iri IS NULL THEN ev.term_id ELSE n.short_form END AS term_id, 1 + coalesce(d.hops, 0) AS steps, d.last FROM ev LEFT JOIN (SELECT iri, {_DEAD} AS gone FROM ols_terms) t ON t.iri = ev.iri LEFT JOIN done d ON d.origin = ev.iri LEFT JOIN ols_terms n ON n.iri = d.iri
WHERE t.gone IS NULL OR NOT t.gone OR d.iri IS NOT NULL""",
}
