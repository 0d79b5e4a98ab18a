"""Queries over what clients do and ask, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators import client, nested, segments, upkeep
from termweave.plans import service
from termweave.session import table
from termweave.sinks import responses
from termweave.sources import adapter

KEYS = ["property_value", "property_type"]
BASE = "http://terms.example/"


def _inputs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_to_map").select("row_id", F.col("propertyValue").alias("property_value"), F.col("propertyType").alias("property_type"))


def _votes(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "votes").select("id", *KEYS, "term_id", "vote", "created_at", "loaded_at")


def client_rows(spark, sf_dir: str) -> DataFrame:
    """Every candidate as a client shows it; a row without a label stands for an error."""
    c = table(spark, sf_dir, "candidates")
    error = F.when(F.col("label").isNull(), "no label")
    return c.select("cand_id", client.row_class(F.col("confidence"), error).alias("class"), client.percent(F.col("confidence")).alias("percent"), client.shown_id(F.col("term_id")).alias("curie"))


def in_progress(spark, sf_dir: str) -> DataFrame:
    """Rows to map that no vote answers."""
    return client.in_progress(_inputs(spark, sf_dir), _votes(spark, sf_dir), KEYS).select("row_id")


def fixture_split(spark, sf_dir: str) -> DataFrame:
    semi, anti = client.split_by(_inputs(spark, sf_dir), "property_value", _votes(spark, sf_dir), "property_value")
    return semi.select("row_id", F.lit(True).alias("known")).unionByName(anti.select("row_id", F.lit(False).alias("known")))


def _ordered(spark, sf_dir: str) -> DataFrame:
    return client.in_input_order(_votes(spark, sf_dir).select("id", *KEYS), _inputs(spark, sf_dir), KEYS, "row_id", "id")


def input_order(spark, sf_dir: str) -> DataFrame:
    """Votes in the order of the rows they answer."""
    return _ordered(spark, sf_dir).select("id", "place")


def results_page(spark, sf_dir: str) -> DataFrame:
    return client.page(_ordered(spark, sf_dir), 3, 25).select("id", "place")


def overridden_rows(spark, sf_dir: str) -> DataFrame:
    """Votes with the newest late vote of the same value, type and term in their place."""
    v = _votes(spark, sf_dir)
    late = v.filter("loaded_at > created_at + INTERVAL 7 DAYS").withColumn("age", F.struct("created_at", "id"))
    keys = [*KEYS, "term_id"]
    new = late.groupBy(*(F.coalesce(k, F.lit("")).alias(k) for k in keys)).agg(F.max_by("vote", "age").alias("vote"))
    return client.overridden(v, new, keys, ["vote"]).select("id", "vote")


def visible_rows(spark, sf_dir: str) -> DataFrame:
    """Candidates as they show after all sure preferred ones were approved and all hopeless ones removed."""
    c = table(spark, sf_dir, "candidates").select("cand_id", "query_key", "term_id", "confidence", "preferred")
    return client.visible(c, c.filter("preferred and confidence >= 0.9"), c.filter("confidence < 0.1"), ["query_key"], "term_id").select("cand_id")


def merged_alternatives(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").filter("not isnan(confidence) or confidence is null").select("cand_id", "query_key", "term_id", "confidence", "datasource")
    known = F.coalesce(F.col("datasource") == "vector", F.lit(False))
    return client.merged_alternatives(c.filter(known), c.filter(~known), "query_key", "term_id", "confidence", "cand_id").select("query_key", "cand_id", "place")


def term_lookup(spark, sf_dir: str) -> DataFrame:
    """What is known of every IRI that candidates or cross-references name."""
    t = table(spark, sf_dir, "ols_terms")
    known = t.select("iri", (F.col("is_obsolete") != 0).alias("obsolete"), F.col("term_replaced_by").alias("replaced_by"), F.coalesce(F.col("term_json").contains('"annotation"'), F.lit(False)).alias("noted"))
    wanted = table(spark, sf_dir, "candidates").select(F.col("uri").alias("iri")).unionByName(adapter.xrefs(spark, sf_dir).select(F.col("target_iri").alias("iri"))).unionByName(t.select("iri"))
    return client.lookup(wanted, known)


def base_terms(spark, sf_dir: str) -> DataFrame:
    """Ids of the terms under one base address."""
    return table(spark, sf_dir, "ols_terms").filter(F.startswith("iri", F.lit(BASE + "ch"))).select("iri")


def cached_requests(spark, sf_dir: str) -> DataFrame:
    """Votes whose value and type were loaded within two years of the newest load."""
    stored = table(spark, sf_dir, "text_to_map").select(F.col("propertyValue").alias("property_value"), F.col("propertyType").alias("property_type"), "loaded_at")
    newest = stored.agg(F.max("loaded_at").alias("_now"))
    return client.cached(_votes(spark, sf_dir), stored.crossJoin(F.broadcast(newest)), ["property_value"], "property_type", "loaded_at", F.col("_now") - F.expr("INTERVAL 730 DAYS")).select("id")


def source_uris(spark, sf_dir: str) -> DataFrame:
    """The sources that candidates name, in capitals, with their addresses; ontologies have one here, databases none."""
    names = table(spark, sf_dir, "candidates").select(F.upper("datasource").alias("name")).unionByName(table(spark, sf_dir, "candidates").select(F.upper("ontology").alias("name"))).filter("name is not null").distinct()
    known = table(spark, sf_dir, "ols_terms").select(F.lit(1).alias("ord"), F.col("ontology_name").alias("name")).distinct().withColumn("uri", F.concat(F.lit(BASE), "name", F.lit("/")))
    return client.with_uri(names, "name", known)


def ontology_presets(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "property_types").select("type_name", "namespaces")
    every = table(spark, sf_dir, "ols_terms").select(F.col("ontology_name").alias("o")).filter("o is not null").distinct()
    return client.presets(given, "namespaces", every, "o").select("type_name", F.array_join("namespaces", ",").alias("ontologies"))


def models_listing(spark, sf_dir: str) -> DataFrame:
    """Models in order of their first vector; those with vectors of texts to map can embed."""
    e = table(spark, sf_dir, "embedding_store").filter("model is not null")
    m = e.groupBy("model").agg(F.min("emb_id").alias("ord"), F.bool_or(F.col("source_type") == "property").alias("can_embed"))
    return client.default_model(m)


def types_listing(spark, sf_dir: str) -> DataFrame:
    """Property types that can be asked for, no type among them."""
    t = table(spark, sf_dir, "property_types").select("type_name")
    return t.unionByName(t.select(F.lit(None).cast("string").alias("type_name")).limit(1))


def short_forms(spark, sf_dir: str) -> DataFrame:
    """Short forms by a configuration in which every other ontology has a prefix of its own and two bases."""
    t = table(spark, sf_dir, "ols_terms").select("iri", F.col("ontology_name").alias("ontology"))
    o = t.select("ontology").filter("ontology is not null").distinct()
    odd = F.length("ontology") % 2 == 1
    o = o.select("ontology", F.when(odd, F.concat(F.lit("My"), "ontology")).alias("preferred"), F.when(odd, F.array(F.concat(F.lit(BASE), "ontology", F.lit("/")), F.concat(F.lit(BASE), "ontology", F.lit("/"), F.upper("ontology"), F.lit("_")))).alias("bases"))
    return client.short_forms(t, o).select("iri", "short_form")


def packed_texts(spark, sf_dir: str) -> DataFrame:
    """Values stored compressed, or plain where their number is even, and read again."""
    t = table(spark, sf_dir, "text_to_map").select("row_id", "propertyValue")
    stored = F.when(F.col("row_id") % 2 == 0, F.encode("propertyValue", "UTF-8")).otherwise(client.packed(F.col("propertyValue")))
    return t.withColumn("stored", stored).select("row_id", client.unpacked(F.col("stored")).alias("text"))


def event_lines(spark, sf_dir: str) -> DataFrame:
    """Stored responses as the events of one stream: a result each with its counts, then the end."""
    r = table(spark, sf_dir, "map_responses").select(F.col("response_id").alias("ord"), "body")
    return responses.event_rows(r, "ord").select("ord", "type", "completed", "total")


def votes_appended(spark, sf_dir: str) -> DataFrame:
    """Votes for every value that has none, behind the stored ones."""
    v = _votes(spark, sf_dir).select("id", "property_value", "vote")
    new = _inputs(spark, sf_dir).filter("property_value is not null").select("property_value").distinct().join(v.select("property_value"), "property_value", "left_anti")
    return v.unionByName(new.select(F.lit(None).cast("long").alias("id"), "property_value", F.lit("up").alias("vote")))


def label_rows(spark, sf_dir: str) -> DataFrame:
    """Terms whose label a property is, on every row that asks for it."""
    rows = table(spark, sf_dir, "text_to_map").select("row_id", "propertyType", "propertyValue")
    props = service.distinct_properties(rows, "propertyType", "propertyValue", "row_id")
    t = table(spark, sf_dir, "ols_terms").filter("label is not null").select("iri", F.lower("label").alias("low"))
    results = props.withColumn("low", F.lower("text")).join(t, "low").select("prop_id", "iri")
    return service.fan_out(results, props, rows, "propertyType", "propertyValue").select("row_id", "iri")


def resolved_evidence(spark, sf_dir: str) -> DataFrame:
    """Candidates with what is known of their term; where nothing is, the query stands for its label."""
    e = adapter.evidence(spark, sf_dir)
    t = adapter.terms(spark, sf_dir).filter("not obsolete").select("iri", F.col("label").alias("_label"), F.col("short_form").alias("_id"))
    return e.join(t, "iri", "left").select("seq", F.coalesce("label", "_label", "prop_id").alias("label"), F.coalesce("_id", "term_id").alias("term_id"))


def unique_segments(spark, sf_dir: str) -> DataFrame:
    """Paragraphs of each document, those that differ in case alone once."""
    return segments.unique_texts(segments.paragraph_rows(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id").select("doc_id", "text")


def segment_best(spark, sf_dir: str) -> DataFrame:
    """The best score of every label among the candidates."""
    return client.best_per_text(adapter.evidence(spark, sf_dir).filter("label is not null"), "label", "confidence").select("label", F.round("confidence", 6).alias("confidence"))


def evictable_jobs(spark, sf_dir: str) -> DataFrame:
    """Users as jobs: begun with their first event, done with their first error, collected if they ever bought; those that may go a day after the last event."""
    e = table(spark, sf_dir, "events")
    jobs = e.groupBy("user_id").agg(F.min("ts").alias("started"), F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("done"), F.bool_or(F.col("event_type") == "purchase").alias("collected"))
    now = e.agg((F.min("ts") + F.expr("INTERVAL 3 HOURS")).alias("now"))
    return jobs.crossJoin(F.broadcast(now)).filter(upkeep.evictable(F.col("done"), F.col("started"), F.col("collected"), F.col("now"))).select("user_id")


def maintenance(spark, sf_dir: str, days: int = 20, cap: int = 50_000) -> DataFrame:
    """The store after one round of upkeep: what has expired goes, then what is too much."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "props")
    kept = upkeep.maintain(e, "ts", "event_id", F.octet_length("props"), days, cap)
    return kept.select("event_id")


def counters(spark, sf_dir: str) -> DataFrame:
    """A snapshot of what was served: by source, how many candidates, queries, whole answers and unscored ones."""
    c = table(spark, sf_dir, "candidates")
    score = F.col("confidence")
    return c.groupBy(F.coalesce("datasource", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if((score >= 0.9) & ~F.isnan(score)).alias("sure"), F.count_if(score.isNull() | F.isnan(score)).alias("unscored"))


def client_table(spark, sf_dir: str) -> DataFrame:
    """Candidates as lines of a client's download, seven columns, missing ones empty."""
    c = table(spark, sf_dir, "candidates").filter("not isnan(confidence) or confidence is null")
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    return c.select("cand_id", F.concat_ws("\t", text("query_key"), F.lit("unspecified"), text("label"), text("term_id"), text("uri"), F.when(F.col("confidence").isNull(), "").otherwise(F.format_string("%.4f", "confidence")), text("datasource")).alias("line"))


def p6_broken(spark, sf_dir: str) -> DataFrame:
    """Bodies that are no JSON and so give no rows, by table."""
    a = nested.broken_bodies(table(spark, sf_dir, "map_responses"), "response_id", "body").select(F.lit("map_responses").alias("tbl"), F.col("response_id").alias("rec_id"))
    b = nested.broken_bodies(table(spark, sf_dir, "v2_annotations"), "annotation_id", "body").select(F.lit("v2_annotations").alias("tbl"), F.col("annotation_id").alias("rec_id"))
    return a.unionByName(b)


QUERIES = {f.__name__: f for f in (
    client_rows, in_progress, fixture_split, input_order, results_page, overridden_rows, visible_rows, merged_alternatives, term_lookup, base_terms, cached_requests, source_uris, ontology_presets, models_listing,
    types_listing, short_forms, packed_texts, event_lines, votes_appended, label_rows, resolved_evidence, unique_segments, segment_best, evictable_jobs, maintenance, counters, client_table, p6_broken,
)}

_IN = "i AS (SELECT row_id, propertyValue AS property_value, propertyType AS property_type FROM text_to_map)"
_EQ = lambda a, b, *ks: " AND ".join(f"coalesce({a}.{k}, '') = coalesce({b}.{k}, '')" for k in ks)
_ORDERED = f"""{_IN}, f AS (SELECT coalesce(property_value, '') AS a, coalesce(property_type, '') AS b, min(row_id) AS pos FROM i GROUP BY ALL),
o AS (SELECT id, row_number() OVER (ORDER BY coalesce(pos, 9999), id) AS place FROM votes LEFT JOIN f ON coalesce(property_value, '') = a AND coalesce(property_type, '') = b)"""

SQL = {
    "client_rows": """SELECT cand_id, CASE WHEN label IS NULL THEN 'error-row' WHEN confidence IS NULL OR isnan(confidence) THEN 'unmapped' WHEN confidence >= 0.9 THEN 'automatic' WHEN confidence < 0.2 THEN 'low-score' ELSE 'curation' END AS class,
  CASE WHEN confidence IS NULL OR isnan(confidence) THEN '' ELSE printf('%.2f%%', confidence * 100) END AS percent, regexp_replace(coalesce(term_id, ''), '^(.*?)_(\\d)', '\\1:\\2') AS curie FROM candidates""",
    "in_progress": f"WITH {_IN} SELECT row_id FROM i WHERE NOT EXISTS (SELECT 1 FROM votes v WHERE {_EQ('i', 'v', *KEYS)})",
    "fixture_split": "SELECT row_id, coalesce(lower(propertyValue) IN (SELECT lower(property_value) FROM votes WHERE property_value IS NOT NULL), false) AS known FROM text_to_map",
    "input_order": f"WITH {_ORDERED} SELECT id, place FROM o",
    "results_page": f"WITH {_ORDERED} SELECT id, place FROM o WHERE place > 75 AND place <= 100",
    "overridden_rows": f"""WITH n AS (SELECT coalesce(property_value, '') AS property_value, coalesce(property_type, '') AS property_type, coalesce(term_id, '') AS term_id, arg_max(vote, {{'c': created_at, 'i': id}}) AS vote FROM votes WHERE loaded_at > created_at + INTERVAL 7 DAYS GROUP BY ALL)
SELECT v.id, coalesce(n.vote, v.vote) AS vote FROM votes v LEFT JOIN n ON {_EQ('v', 'n', *KEYS, 'term_id')}""",
    "visible_rows": """WITH c AS (SELECT *, coalesce(query_key, '') AS q, coalesce(term_id, '') AS t FROM candidates), gone AS (SELECT DISTINCT q, t FROM c WHERE confidence < 0.1), fit AS (SELECT DISTINCT q, t FROM c WHERE preferred AND confidence >= 0.9)
SELECT cand_id FROM c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.q = c.q AND g.t = c.t) AND (EXISTS (SELECT 1 FROM fit f WHERE f.q = c.q AND f.t = c.t) OR NOT EXISTS (SELECT 1 FROM fit f WHERE f.q = c.q))""",
    "merged_alternatives": """WITH c AS (SELECT *, coalesce(datasource = 'vector', false) AS known FROM candidates WHERE confidence IS NULL OR NOT isnan(confidence)),
k AS (SELECT * FROM c WHERE known UNION ALL SELECT * FROM c WHERE NOT known AND NOT EXISTS (SELECT 1 FROM c d WHERE d.known AND coalesce(d.query_key, '') = coalesce(c.query_key, '') AND coalesce(d.term_id, '') = coalesce(c.term_id, '')))
SELECT query_key, cand_id, row_number() OVER (PARTITION BY query_key ORDER BY confidence DESC NULLS LAST, cand_id) AS place FROM k""",
    "term_lookup": """WITH w AS (SELECT uri AS iri FROM candidates UNION SELECT term_replaced_by FROM ols_terms UNION SELECT iri FROM ols_terms UNION SELECT unnest(CAST(json_extract(term_json, '$.annotation.has_dbxref') AS VARCHAR[])) FROM ols_terms WHERE json_type(term_json, '$.annotation.has_dbxref') = 'ARRAY')
SELECT iri, CASE WHEN t.iri IS NULL THEN 'missing' WHEN is_obsolete IS NOT NULL AND (is_obsolete = 0 OR term_replaced_by IS NOT NULL OR coalesce(contains(term_json, '"annotation"'), false)) THEN 'complete' ELSE 'incomplete' END AS state FROM w LEFT JOIN ols_terms t USING (iri) WHERE iri IS NOT NULL""",
    "base_terms": f"SELECT iri FROM ols_terms WHERE starts_with(iri, '{BASE}ch')",
    "cached_requests": "SELECT id FROM votes v WHERE EXISTS (SELECT 1 FROM text_to_map t WHERE t.propertyValue = v.property_value AND coalesce(t.propertyType, '') = coalesce(v.property_type, '') AND t.loaded_at >= (SELECT max(loaded_at) FROM text_to_map) - INTERVAL 730 DAYS)",
    "source_uris": f"SELECT name, coalesce('{BASE}' || o || '/', name) AS uri FROM (SELECT upper(datasource) AS name FROM candidates WHERE datasource IS NOT NULL UNION SELECT upper(ontology) FROM candidates WHERE ontology IS NOT NULL) LEFT JOIN (SELECT DISTINCT ontology_name AS o FROM ols_terms) ON lower(name) = o",
    "ontology_presets": "SELECT type_name, array_to_string(list_concat(namespaces, list_filter((SELECT list_sort(list(DISTINCT ontology_name)) FROM ols_terms), lambda o: NOT list_contains(namespaces, o))), ',') AS ontologies FROM property_types",
    "models_listing": """WITH m AS (SELECT model, min(emb_id) AS ord, bool_or(coalesce(source_type = 'property', false)) AS can_embed FROM embedding_store WHERE model IS NOT NULL GROUP BY model)
SELECT model, ord, can_embed, can_embed AND ord = (SELECT min(ord) FROM m WHERE can_embed) AS is_default FROM m""",
    "types_listing": "SELECT type_name FROM property_types UNION ALL SELECT NULL",
    "short_forms": f"""SELECT iri, CASE WHEN length(ontology_name) % 2 = 1 AND starts_with(iri, '{BASE}' || ontology_name || '/' || upper(ontology_name) || '_') THEN 'My' || ontology_name || '_' || substr(iri, length('{BASE}' || ontology_name || '/' || ontology_name || '_') + 1)
  WHEN length(ontology_name) % 2 = 1 AND starts_with(iri, '{BASE}' || ontology_name || '/') THEN 'My' || ontology_name || '_' || substr(iri, length('{BASE}' || ontology_name || '/') + 1) ELSE regexp_extract(iri, '([^/#]*)$', 1) END AS short_form FROM ols_terms""",
    "packed_texts": "SELECT row_id, propertyValue AS text FROM text_to_map",
    "event_lines": "SELECT response_id AS ord, 'result' AS type, row_number() OVER (ORDER BY response_id) AS completed, count(*) OVER () AS total FROM map_responses UNION ALL SELECT NULL, 'done', count(*), count(*) FROM map_responses",
    "votes_appended": "SELECT id, property_value, vote FROM votes UNION ALL SELECT NULL, v, 'up' FROM (SELECT DISTINCT propertyValue AS v FROM text_to_map WHERE propertyValue IS NOT NULL) WHERE v NOT IN (SELECT property_value FROM votes WHERE property_value IS NOT NULL)",
    "label_rows": "SELECT row_id, iri FROM text_to_map JOIN ols_terms ON lower(label) = lower(propertyValue) WHERE trim(propertyValue) <> ''",
    "resolved_evidence": f"WITH {adapter.EVIDENCE_SQL} SELECT seq, coalesce(ev.label, t.label, prop_id) AS label, coalesce(t.short_form, ev.term_id) AS term_id FROM ev LEFT JOIN (SELECT * FROM ols_terms WHERE is_obsolete = 0) t ON t.iri = ev.iri",
    "segment_best": f"WITH {adapter.EVIDENCE_SQL} SELECT label, round(max(confidence), 6) AS confidence FROM ev WHERE label IS NOT NULL GROUP BY label",
    "evictable_jobs": """WITH j AS (SELECT user_id, min(ts) AS started, min(ts) FILTER (event_type = 'error') AS done, bool_or(event_type = 'purchase') AS collected FROM events GROUP BY user_id), n AS (SELECT min(ts) + INTERVAL 3 HOURS AS now FROM events)
SELECT user_id FROM j, n WHERE coalesce(collected, false) OR coalesce(done < now - INTERVAL 30 MINUTES, false) OR (done IS NULL AND started < now - INTERVAL 6 HOURS)""",
    "maintenance": """WITH f AS (SELECT *, strlen(props) AS s FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAYS)
SELECT event_id FROM (SELECT event_id, sum(s) OVER (ORDER BY ts DESC NULLS LAST, event_id DESC ROWS UNBOUNDED PRECEDING) AS run, sum(s) OVER () AS total FROM f) WHERE total <= 50000 OR run <= 45000""",
    "counters": "SELECT coalesce(datasource, '') AS source, count(*) AS n, count(*) FILTER (confidence >= 0.9 AND NOT isnan(confidence)) AS sure, count(*) FILTER (confidence IS NULL OR isnan(confidence)) AS unscored FROM candidates GROUP BY ALL",
    "client_table": """SELECT cand_id, concat_ws(chr(9), coalesce(query_key, ''), 'unspecified', coalesce(label, ''), coalesce(term_id, ''), coalesce(uri, ''), CASE WHEN confidence IS NULL THEN '' ELSE printf('%.4f', confidence) END, coalesce(datasource, '')) AS line FROM candidates WHERE confidence IS NULL OR NOT isnan(confidence)""",
    "p6_broken": "SELECT 'map_responses' AS tbl, response_id AS rec_id FROM map_responses WHERE body IS NOT NULL AND NOT json_valid(body) UNION ALL SELECT 'v2_annotations', annotation_id FROM v2_annotations WHERE body IS NOT NULL AND NOT json_valid(body)",
}
