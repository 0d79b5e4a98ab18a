"""Queries over channels, identifiers, text and upkeep, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions import evidence as ev
from termweave.functions import ids
from termweave.functions import similarity as sim
from termweave.functions import variants as var
from termweave.operators import channels, obsolete, registry, segments, upkeep
from termweave.session import table
from termweave.skew import ordered_positions
from termweave.sources.adapter import EVIDENCE_SQL, NAMES_SQL, evidence, properties, terms

_TOK = lambda c: f"list_distinct(list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"
_STOP = "[" + ", ".join(f"'{w}'" for w in sim.STOPWORDS) + "]"
_CON = lambda c: f"list_filter({_TOK(c)}, lambda w: NOT list_contains({_STOP}, w))"
_TEXTS = "texts AS (SELECT DISTINCT propertyValue AS text FROM text_to_map WHERE trim(propertyValue) <> '')"


def _names(spark, sf_dir: str) -> DataFrame:
    t = terms(spark, sf_dir)
    return t.select("iri", F.posexplode(F.concat(F.array("label"), "synonyms")).alias("ord", "name")).filter("name is not null")


def _texts(spark, sf_dir: str) -> DataFrame:
    return properties(spark, sf_dir).select("text").distinct()


def tokens_jaccard(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "votes")
    a, b = sim.tokens(F.col("property_value")), sim.tokens(F.col("term_label"))
    return v.select("id", F.size(a).alias("n_value"), F.size(b).alias("n_label"), F.round(sim.jaccard(a, b), 6).alias("jaccard"))


def edit_blended(spark, sf_dir: str) -> DataFrame:
    """Edits count characters, also in the twin, whose engine counts bytes."""
    v = table(spark, sf_dir, "votes")
    return v.select("id", F.round(sim.edit_similarity(F.col("property_value"), F.col("term_label")), 6).alias("edit"), F.round(sim.blended(F.col("property_value"), F.col("term_label")), 6).alias("blended"))


def containment_score(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "votes")
    return v.select("id", F.round(sim.containment(F.col("term_label"), F.col("property_value")), 6).alias("score"))


def exact_label_match(spark, sf_dir: str) -> DataFrame:
    """Every property with the terms whose label it is, whatever the case; '' if there is none."""
    t = terms(spark, sf_dir).filter("label is not null").select(F.lower("label").alias("low"), "iri")
    p = properties(spark, sf_dir).withColumn("low", F.lower("text"))
    return p.join(t, "low", "left").select("prop_id", F.coalesce("iri", F.lit("")).alias("iri"))


def tightest_containment(spark, sf_dir: str) -> DataFrame:
    c = channels.containment_candidates(_texts(spark, sf_dir), _names(spark, sf_dir))
    return c.select("text", "iri", "n", F.round(ev.tier_confidence(F.lit("PARTIAL"), F.col("score")), 6).alias("confidence"))


def fuzzy_topk(spark, sf_dir: str) -> DataFrame:
    c = channels.similar_names(_texts(spark, sf_dir), _names(spark, sf_dir))
    return c.select("text", "iri", "place", F.round("jaccard", 6).alias("jaccard"))


def tag_spans(spark, sf_dir: str) -> DataFrame:
    return channels.tag_text(table(spark, sf_dir, "documents"), "doc_id", "text", channels.dictionary(terms(spark, sf_dir))).select("doc_id", "start", "end", "iri", "string_type")


def tag_values(spark, sf_dir: str) -> DataFrame:
    hits = channels.tag_evidence(channels.tag_values(_texts(spark, sf_dir), channels.dictionary(terms(spark, sf_dir))))
    return hits.select("text", "iri", "kind", F.round("coverage", 6).alias("coverage"), F.round("confidence", 6).alias("confidence"))


def variant_attribution(spark, sf_dir: str) -> DataFrame:
    """Whole-label hits of the texts themselves, then of their variants at a discount, each term once per text."""
    texts = _texts(spark, sf_dir)
    each = texts.select("text", F.posexplode(F.concat(F.array("text"), var.variants(F.col("text")))).alias("ord", "variant"))
    entries = channels.dictionary(terms(spark, sf_dir)).groupBy("surface", "iri").agg(F.min("string_type").alias("string_type"))
    hits = each.join(entries, F.lower("variant") == F.col("surface"))
    best = hits.groupBy("text", "iri").agg(F.min(F.struct("ord", "string_type", "variant")).alias("b")).select("text", "iri", "b.*").withColumn("coverage", F.lit(1.0))
    scored = channels.tag_evidence(best)
    return scored.select("text", "iri", "variant", "kind", F.round(F.col("confidence") * F.when(F.col("ord") > 0, ev.VARIANT_DISCOUNT).otherwise(1.0), 6).alias("confidence"))


def query_variants(spark, sf_dir: str) -> DataFrame:
    """The variants of every text, in order, in one string."""
    return _texts(spark, sf_dir).select("text", F.array_join(var.variants(F.col("text")), " | ").alias("variants"))


def _near(spark, sf_dir: str, k: int) -> DataFrame:
    """Stated queries: every vector whose id is divisible by 50, against all."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return channels.nearest_vectors(e.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), e, k)


def vector_topk(spark, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 10).select("query_id", "id", "place", F.round("similarity", 6).alias("similarity"))


def similar_expansion(spark, sf_dir: str) -> DataFrame:
    """Seeds stand for the stated query vectors by the number in their identifier."""
    near = _near(spark, sf_dir, 50)
    edges = near.select(F.concat(F.lit("v"), "query_id").alias("iri"), F.concat(F.lit("v"), "id").alias("other"), "similarity")
    n = table(spark, sf_dir, "embeddings").agg(F.floor((F.max("vec_id") + 50) / 50).alias("m"))
    seeds = evidence(spark, sf_dir).crossJoin(F.broadcast(n)).withColumn("iri", F.concat(F.lit("v"), F.regexp_extract("term_id", "([0-9]+)$", 1).cast("long") % F.col("m") * 50))
    return channels.expand_similar(seeds, edges, 0.4).select("prop_id", "seq", "other", F.round("confidence", 6).alias("confidence"))


def xref_expansion(spark, sf_dir: str) -> DataFrame:
    """Cross-references are the replacement edges; their distance comes from the label's length."""
    x = terms(spark, sf_dir).filter("replaced_by is not null").select(F.col("iri").alias("source_iri"), F.col("replaced_by").alias("target_iri"), (F.coalesce(F.length("label"), F.lit(0)) % 3 + 1).alias("distance"))
    return channels.expand_xrefs(evidence(spark, sf_dir), x).select("prop_id", "seq", "target_iri", "distance", F.round("confidence", 6).alias("confidence"))


def obsolete_chain(spark, sf_dir: str) -> DataFrame:
    return obsolete.resolve_chains(terms(spark, sf_dir)).drop("trail")


def live_evidence(spark, sf_dir: str) -> DataFrame:
    """Evidence with obsolete terms exchanged for what replaces them, or dropped."""
    t = terms(spark, sf_dir)
    dead = t.select("iri", obsolete.is_obsolete(F.col("obsolete"), F.col("label")).alias("dead"))
    e = evidence(spark, sf_dir).select("prop_id", "seq", "iri").join(dead, "iri", "left")
    e = e.join(obsolete.resolve_chains(t).select(F.col("origin").alias("iri"), F.col("iri").alias("to")), "iri", "left")
    return e.filter("dead is null or not dead or to is not null").select("prop_id", "seq", F.coalesce("to", "iri").alias("iri"))


def _registry(spark, sf_dir: str) -> DataFrame:
    """One entry per ontology, with a synonym that is its name turned round."""
    names = table(spark, sf_dir, "ols_terms").select(F.col("ontology_name").alias("prefix")).filter("prefix is not null").distinct()
    base = F.concat(F.lit("http://terms.example/"), F.col("prefix"), F.lit("/"), F.upper("prefix"), F.lit("_$1"))
    return names.select(F.lit(1).alias("ord"), "prefix", F.upper("prefix").alias("preferred_prefix"), F.array(F.reverse("prefix")).alias("synonyms"), base.alias("uri_format"), F.lit("[0-9]{7}").alias("pattern"))


def longest_prefix(spark, sf_dir: str) -> DataFrame:
    r = _registry(spark, sf_dir)
    wide = r.withColumn("uri_format", F.concat(F.lit("http://terms.example/"), "prefix", F.lit("/$1"))).withColumn("prefix", F.concat(F.lit("all-"), "prefix"))
    t = table(spark, sf_dir, "ols_terms").select("iri")
    found = registry.longest_prefix(t, "iri", r.unionByName(wide))
    return found.select("iri", "prefix", F.concat("prefix", F.lit(":"), F.expr("substring(iri, length(base) + 1)")).alias("curie"))


def short_form_to_iri(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").select("cand_id", ids.compact(F.col("term_id")).alias("curie"))
    return registry.expand(c, "curie", registry.registry_index(_registry(spark, sf_dir))).select("cand_id", "iri")


def ontology_top10(spark, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "ols_terms").groupBy(F.col("ontology_name").alias("ontology")).agg(F.count(F.lit(1)).alias("n"))
    return t.orderBy(F.desc("n"), "ontology").limit(10)


def store_counts(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embedding_store").groupBy("source_type").agg(F.count_distinct("text").alias("texts"), F.count(F.lit(1)).alias("n"))


def multi_high(spark, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir).filter("confidence >= 0.9")
    return e.groupBy("prop_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def mapped_summary(spark, sf_dir: str) -> DataFrame:
    """Per property: whether it is mapped, its class, its kinds of match in order of first use."""
    e = evidence(spark, sf_dir)
    per_kind = e.groupBy("prop_id", "kind").agg(F.min("seq").alias("seq"), F.max("confidence").alias("top"))
    top = F.max("top")
    cls = F.when(top >= 0.9, "high").when(top < 0.2, "low").otherwise("middle")
    return per_kind.groupBy("prop_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda s: s["kind"]), ", ").alias("kinds"), cls.alias("class"), (top >= 0.9).alias("mapped"))


def vote_history_all(spark, sf_dir: str) -> DataFrame:
    """All votes of each value, newest first (S18 has no limit)."""
    v = table(spark, sf_dir, "votes").filter("property_value is not null").select("property_value", "created_at", "id", "vote")
    return ordered_positions(v, "property_value", [F.col("created_at").desc(), F.col("id").desc()]).select("property_value", "place", "id", "vote")


def latest_votes(spark, sf_dir: str) -> DataFrame:
    """Late rows upserted over the others: the newest vote of each value and term."""
    v = table(spark, sf_dir, "votes").select("id", "property_value", "term_id", "vote", "created_at", F.struct("created_at", "id").alias("age"), (F.col("loaded_at") > F.col("created_at") + F.expr("INTERVAL 7 DAYS")).alias("late"))
    v = v.withColumn("late", F.coalesce("late", F.lit(False)))
    return upkeep.upsert(v.filter("not late"), v.filter("late"), ["property_value", "term_id"], "age").select("id", "property_value", "term_id", "vote")


def failed_terms(spark, sf_dir: str) -> DataFrame:
    """Ids that candidates name and no live term has, added to those that votes name."""
    known = table(spark, sf_dir, "ols_terms").filter("is_obsolete = 0").select(F.col("short_form").alias("term_id"))
    missing = lambda n: table(spark, sf_dir, n).select("term_id").filter("term_id is not null").distinct().join(known, "term_id", "left_anti")
    return upkeep.insert_absent(missing("votes"), missing("candidates"), "term_id")


def evict_down_voted(spark, sf_dir: str) -> DataFrame:
    """Votes without the values and terms that were ever voted down."""
    v = table(spark, sf_dir, "votes").select("id", "property_value", "term_id", "vote")
    return upkeep.evict(v, v.filter("vote = 'down'"), ["property_value", "term_id"])


def ttl_fresh(spark, sf_dir: str, days: int = 3) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    now = e.agg(F.max("ts").alias("now"))  # one row
    return e.crossJoin(F.broadcast(now)).filter(upkeep.fresh(F.col("ts"), F.col("now"), days)).select("event_id")


def size_cap(spark, sf_dir: str, cap: int = 5_000) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "props")
    return upkeep.newest_within(e, "ts", "event_id", F.octet_length("props"), cap).select("event_id")


def seeded_sample(spark, sf_dir: str) -> DataFrame:
    return upkeep.seeded_sample(table(spark, sf_dir, "text_to_map").select("row_id", "propertyValue"), "row_id", 100)


def paragraph_rows(spark, sf_dir: str) -> DataFrame:
    return segments.paragraph_rows(table(spark, sf_dir, "documents"), "doc_id", "text")


def annotate_segments(spark, sf_dir: str) -> DataFrame:
    """Phrases of the documents merged with what the dictionary tags."""
    docs = table(spark, sf_dir, "documents")
    return segments.merge_rows(segments.segment_rows(docs, "doc_id", "text"), tag_spans(spark, sf_dir), "doc_id")


def greedy_spans(spark, sf_dir: str) -> DataFrame:
    return segments.greedy_rows(tag_spans(spark, sf_dir), "doc_id")


def gap_fill(spark, sf_dir: str) -> DataFrame:
    """The text between paragraphs."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return segments.gaps(segments.paragraph_rows(docs, "doc_id", "text"), docs.select("doc_id", F.length("text").alias("n")), "doc_id")


QUERIES = {f.__name__: f for f in (
    tokens_jaccard, edit_blended, containment_score, exact_label_match, tightest_containment, fuzzy_topk, tag_spans, tag_values, variant_attribution, query_variants,
    vector_topk, similar_expansion, xref_expansion, obsolete_chain, live_evidence, longest_prefix, short_form_to_iri, ontology_top10, store_counts, multi_high, mapped_summary,
    vote_history_all, latest_votes, failed_terms, evict_down_voted, ttl_fresh, size_cap, seeded_sample, paragraph_rows, annotate_segments, greedy_spans, gap_fill,
)}

_JAC = "round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6)"
_DEAD = "(coalesce(is_obsolete <> 0, false) OR coalesce(lower(label) LIKE 'obsolete%', false))"
_CHAIN = f"""WITH RECURSIVE walk AS (
  SELECT iri AS origin, [iri] AS seen, term_replaced_by AS nxt, 0 AS hops, CAST(NULL AS VARCHAR) AS iri, true AS dead FROM ols_terms WHERE iri IS NOT NULL AND {_DEAD}
  UNION ALL
  SELECT origin, list_append(seen, t.iri), t.term_replaced_by, hops + 1, t.iri, {_DEAD} FROM walk JOIN ols_terms t ON t.iri = walk.nxt
  WHERE walk.dead AND hops < 5 AND NOT list_contains(seen, walk.nxt)),
chain AS (SELECT origin, iri, hops FROM walk WHERE NOT dead)"""
_NEAR = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0),
near AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 9) AS s FROM q, embeddings WHERE vec_id <> query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS place FROM near)"""
_DELIMS = "' ,.;:!?' || chr(9) || chr(10) || '()[]{}\"''/\\-_'"
_DICT = f"{NAMES_SQL}, dict AS (SELECT lower(name) AS surface, iri, min(CASE WHEN ord = 0 THEN 'label' ELSE 'synonym' END) AS string_type FROM names WHERE trim(lower(name)) <> '' GROUP BY ALL)"

SQL = {
    "tokens_jaccard": f"SELECT id, len(a) AS n_value, len(b) AS n_label, {_JAC} AS jaccard FROM (SELECT id, {_TOK('property_value')} AS a, {_TOK('term_label')} AS b FROM votes)",
    "containment_score": f"SELECT id, round(CASE WHEN len(q) = 0 OR NOT list_has_all(c, q) THEN 0.0 WHEN len(c) <= len(q) THEN 1.0 ELSE 0.5 + 0.5 * len(q) / len(c) END, 6) AS score FROM (SELECT id, {_CON('term_label')} AS q, {_CON('property_value')} AS c FROM votes)",
    "exact_label_match": """SELECT prop_id, coalesce(iri, '') AS iri FROM (SELECT propertyType, propertyValue AS text, min(row_id) AS prop_id FROM text_to_map WHERE trim(propertyValue) <> '' GROUP BY ALL)
  LEFT JOIN ols_terms ON lower(label) = lower(text)""",
    "tightest_containment": f"""WITH {NAMES_SQL}, {_TEXTS}, n AS (SELECT iri, {_CON('name')} AS nt FROM names), q AS (SELECT text, {_CON('text')} AS qt FROM texts),
per AS (SELECT text, iri, min(len(nt)) AS n FROM q JOIN n ON len(qt) > 0 AND list_has_all(nt, qt) GROUP BY ALL)
SELECT text, iri, n, round(0.89 * (CASE WHEN n <= min(n) OVER (PARTITION BY text) THEN 1.0 ELSE 0.5 + 0.5 * min(n) OVER (PARTITION BY text) / n END), 6) AS confidence FROM per""",
    "fuzzy_topk": f"""WITH {NAMES_SQL}, {_TEXTS}, n AS (SELECT iri, {_TOK('name')} AS b FROM names), q AS (SELECT text, {_TOK('text')} AS a FROM texts),
per AS (SELECT text, iri, max(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))) AS j FROM q JOIN n ON len(a) > 0 AND len(b) > 0 AND len(b) <= 2 * len(a) AND len(a) <= 2 * len(b) AND list_has_any(a, b) GROUP BY ALL)
SELECT text, iri, place, round(j, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY round(j, 9) DESC, iri) AS place FROM per WHERE j >= 0.5 - 1e-9) WHERE place <= 20""",
    "tag_spans": f"""WITH {_DICT}, d AS (SELECT doc_id, text, list_filter(range(0, length(text) + 2), lambda i: i = 0 OR i = length(text) + 1 OR contains({_DELIMS}, text[i])) AS cut FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, cut, unnest(range(1, len(cut))) AS k FROM d), w2 AS (SELECT doc_id, text, cut[k] AS s, unnest(list_slice(cut, k + 1, k + 40)) AS e FROM w WHERE cut[k + 1] > cut[k] + 1),
x AS (SELECT doc_id, s AS "start", e - 1 AS "end", substr(text, s + 1, e - s - 1) AS raw FROM w2 WHERE NOT contains({_DELIMS}, text[e - 1]) AND e - s - 1 <= 120)
SELECT doc_id, "start", "end", iri, min(string_type) AS string_type FROM x JOIN dict ON lower(raw) = surface WHERE strlen(raw) >= 6 GROUP BY ALL""",
    "vector_topk": f"WITH {_NEAR} SELECT query_id, id, place, round(s, 6) AS similarity FROM ranked WHERE place <= 10",
    "similar_expansion": f"""WITH {EVIDENCE_SQL}, {_NEAR}, m AS (SELECT (max(vec_id) + 50) // 50 AS m FROM embeddings)
SELECT prop_id, seq, 'v' || id AS other, round(confidence * 0.7 * s, 6) AS confidence FROM ev, m, ranked
WHERE place <= 50 AND confidence > 0.4 AND kind <> 'OLS_EMBEDDING' AND s >= 0.4 AND query_id = CAST(regexp_extract(term_id, '([0-9]+)$', 1) AS BIGINT) % m.m * 50""",
    "xref_expansion": f"""WITH {EVIDENCE_SQL}, x AS (SELECT iri AS source, term_replaced_by AS target_iri, coalesce(length(label), 0) % 3 + 1 AS distance FROM ols_terms WHERE term_replaced_by IS NOT NULL)
SELECT prop_id, seq, target_iri, distance, round(confidence * CASE distance WHEN 1 THEN 0.95 ELSE 0.85 END, 6) AS confidence FROM ev JOIN x ON ev.iri = source WHERE distance <= 2""",
    "obsolete_chain": f"{_CHAIN} SELECT origin, iri, hops FROM chain",
    "live_evidence": f"""{_CHAIN}, {EVIDENCE_SQL} SELECT prop_id, seq, coalesce(c.iri, ev.iri) AS iri FROM ev LEFT JOIN (SELECT iri, {_DEAD} AS dead FROM ols_terms) t ON t.iri = ev.iri
  LEFT JOIN chain c ON c.origin = ev.iri WHERE t.dead IS NULL OR NOT t.dead OR c.iri IS NOT NULL""",
    "longest_prefix": """SELECT iri, CASE WHEN starts_with(local, upper(o) || '_') THEN o ELSE 'all-' || o END AS prefix,
  CASE WHEN starts_with(local, upper(o) || '_') THEN o || ':' || substr(local, length(o) + 2) ELSE 'all-' || o || ':' || local END AS curie
FROM (SELECT iri, split_part(iri, '/', 4) AS o, regexp_extract(iri, '([^/]*)$', 1) AS local FROM ols_terms)""",
    "short_form_to_iri": """SELECT cand_id, CASE WHEN o IS NOT NULL AND regexp_full_match(split_part(term_id, '_', 2), '[0-9]{7}') THEN 'http://terms.example/' || o || '/' || upper(o) || '_' || split_part(term_id, '_', 2)
  ELSE regexp_replace(term_id, '^([^_]+)_', '\\1:') END AS iri FROM candidates LEFT JOIN (SELECT DISTINCT ontology_name AS o FROM ols_terms) ON lower(split_part(term_id, '_', 1)) = o""",
    "ontology_top10": "SELECT ontology_name AS ontology, count(*) AS n FROM ols_terms GROUP BY ALL ORDER BY n DESC, ontology LIMIT 10",
    "store_counts": "SELECT source_type, count(DISTINCT text) AS texts, count(*) AS n FROM embedding_store GROUP BY ALL",
    "multi_high": f"WITH {EVIDENCE_SQL} SELECT prop_id, count(*) AS n FROM ev WHERE confidence >= 0.9 GROUP BY ALL HAVING count(*) > 1",
    "mapped_summary": f"""WITH {EVIDENCE_SQL}, k AS (SELECT prop_id, kind, min(seq) AS seq, max(confidence) AS top FROM ev GROUP BY ALL)
SELECT prop_id, string_agg(kind, ', ' ORDER BY seq) AS kinds, CASE WHEN max(top) >= 0.9 THEN 'high' WHEN max(top) < 0.2 THEN 'low' ELSE 'middle' END AS class, max(top) >= 0.9 AS mapped FROM k GROUP BY prop_id""",
    "vote_history_all": "SELECT property_value, row_number() OVER (PARTITION BY property_value ORDER BY created_at DESC NULLS LAST, id DESC) AS place, id, vote FROM votes WHERE property_value IS NOT NULL",
    "latest_votes": "SELECT id, property_value, term_id, vote FROM (SELECT *, row_number() OVER (PARTITION BY property_value, term_id ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM votes) WHERE rn = 1",
    "failed_terms": "SELECT DISTINCT term_id FROM (SELECT term_id FROM votes UNION ALL SELECT term_id FROM candidates) WHERE term_id IS NOT NULL AND term_id NOT IN (SELECT short_form FROM ols_terms WHERE short_form IS NOT NULL AND is_obsolete = 0)",
    "evict_down_voted": "SELECT id, property_value, term_id, vote FROM votes v WHERE NOT EXISTS (SELECT 1 FROM votes d WHERE d.vote = 'down' AND d.property_value IS NOT DISTINCT FROM v.property_value AND d.term_id IS NOT DISTINCT FROM v.term_id)",
    "ttl_fresh": "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAYS",
    "size_cap": "SELECT event_id FROM (SELECT event_id, sum(strlen(props)) OVER (ORDER BY ts DESC NULLS LAST, event_id DESC ROWS UNBOUNDED PRECEDING) AS run, sum(strlen(props)) OVER () AS total FROM events) WHERE total <= 5000 OR run <= 4500",
    "seeded_sample": "SELECT row_id, propertyValue FROM text_to_map ORDER BY md5(CAST(row_id AS VARCHAR) || ':42') LIMIT 100",
}
