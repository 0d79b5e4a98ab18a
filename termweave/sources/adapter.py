"""The engine's logical tables from the given ones.

terms        ols_terms, with synonyms as an array
properties   the distinct pairs of type and value in text_to_map, numbered by their first row
curated      values of votes that were voted up more often than down
xrefs        replacements, and the cross-references that term_json names
vectors      embedding_store, one model: properties are texts to map, the others term vectors. A vector's text names no term of the table, so a fixed rule
             supplies its term: of the terms with a certain number in their id the one with the smallest hash
evidence     candidates with a score, one row each. The table has no kind of match and no property type, so both come from fixed rules:
             the kind from cand_id, the type from the number in query_key
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.evidence import KINDS
from termweave.session import table

TYPES = ("organism", "disease", "phenotype", "organism part", None)


def synonyms_of(column: str = "synonyms_json") -> Column:
    """An array from a JSON list, a lone JSON string, or null."""
    text = F.col(column)
    lone = F.get_json_object(F.concat(F.lit('{"s":'), text, F.lit("}")), "$.s")
    return F.array_compact(F.coalesce(F.from_json(text, "array<string>"), F.when(lone.isNotNull(), F.array(lone)), F.array().cast("array<string>")))


def terms(spark, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "ols_terms")
    return t.select("iri", "short_form", "label", F.col("ontology_name").alias("ontology"), (F.col("is_obsolete") != 0).alias("obsolete"), F.col("term_replaced_by").alias("replaced_by"), synonyms_of().alias("synonyms"))


def curated(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "votes").filter("property_value is not null and term_id is not null")
    net = F.sum(F.when(F.col("vote") == "up", 1).otherwise(-1))
    return v.groupBy(F.col("property_value").alias("text"), "term_id").agg(net.alias("net")).filter("net > 0").select("text", "term_id", F.lit("votes").alias("datasource"))


def xrefs(spark, sf_dir: str) -> DataFrame:
    """source_iri, target_id, target_iri, target_label, distance. What a term names is no term of the table and keeps its id as IRI."""
    t = table(spark, sf_dir, "ols_terms")
    known = t.select(F.col("iri").alias("target_iri"), F.regexp_replace("short_form", "_", ":").alias("target_id"), F.col("label").alias("target_label"))
    replaced = t.filter("term_replaced_by is not null").select(F.col("iri").alias("source_iri"), F.col("term_replaced_by").alias("target_iri")).join(known, "target_iri", "left")
    named = t.select(F.col("iri").alias("source_iri"), F.explode(F.array_distinct(F.from_json(F.get_json_object("term_json", "$.annotation.has_dbxref"), "array<string>"))).alias("target_id")).filter("target_id is not null")
    named = named.withColumn("target_iri", F.col("target_id")).withColumn("target_label", F.lit(None).cast("string"))
    columns = ("source_iri", "target_id", "target_iri", "target_label")
    return replaced.select(*columns).unionByName(named.select(*columns)).distinct().withColumn("distance", F.lit(1))


def vectors(spark, sf_dir: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(text_vectors: id, text, vector; term_vectors: id, iri, ontology, vector), of usable vectors: 64 finite components that are not all zero."""
    e = table(spark, sf_dir, "embedding_store").filter(F.col("model") == model).select(F.col("emb_id").alias("id"), "text", "source_type", F.col("embedding").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    e = e.filter(F.col("vector").isNotNull() & (F.size("vector") == 64) & finite & F.exists("vector", lambda x: x != 0))
    number = F.regexp_extract("short_form", "[0-9]+$", 0).cast("long")
    t = table(spark, sf_dir, "ols_terms").filter("short_form rlike '[0-9]+$'").groupBy(number.alias("no")).agg(F.min_by(F.struct("iri", F.col("ontology_name").alias("ontology")), F.md5("iri")).alias("t"))
    texts = e.filter("source_type = 'property' and text is not null").select("id", "text", "vector")
    linked = e.filter("source_type <> 'property'").withColumn("no", F.col("id") % 400 + 1000).join(t, "no").select("id", "t.iri", "t.ontology", "vector")
    return texts, linked


def properties(spark, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "text_to_map").filter("trim(propertyValue) <> ''")
    return t.groupBy(F.col("propertyType").alias("property_type"), F.col("propertyValue").alias("text")).agg(F.min("row_id").alias("prop_id"), F.count(F.lit(1)).alias("n_rows"))


def evidence(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").filter("query_key is not null and confidence is not null and not isnan(confidence)")
    number = F.regexp_extract("query_key", "[0-9]+", 0).cast("long") % len(TYPES)
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return c.select(
        F.col("query_key").alias("prop_id"),
        F.col("cand_id").alias("seq"),
        "term_id",
        F.col("uri").alias("iri"),
        "label",
        "ontology",
        "confidence",
        F.element_at(kinds, (F.col("cand_id") % len(KINDS) + 1).cast("int")).alias("kind"),
        "datasource",
        F.element_at(F.array(*(F.lit(t) for t in TYPES)), (number + 1).cast("int")).alias("property_type"),
    )


EVIDENCE_SQL = f"""ev AS (
  SELECT query_key AS prop_id, cand_id AS seq, term_id, uri AS iri, label, ontology, confidence, datasource,
    [{", ".join(f"'{k}'" for k in KINDS)}][cand_id % {len(KINDS)} + 1] AS kind,
    [{", ".join(f"'{t}'" if t else "NULL" for t in TYPES)}][CAST(regexp_extract(query_key, '[0-9]+') AS BIGINT) % {len(TYPES)} + 1] AS property_type
  FROM candidates WHERE query_key IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence))"""

#: Labels and synonyms of each term, in SQL: iri, name, ord (0 is the label).
NAMES_SQL = """names AS (
  SELECT iri, label AS name, 0 AS ord FROM ols_terms WHERE label IS NOT NULL
  UNION ALL
  SELECT iri, unnest(syn) AS name, unnest(range(1, len(syn) + 1)) AS ord FROM (
    SELECT iri, CASE WHEN json_type(synonyms_json) = 'ARRAY' THEN CAST(CAST(synonyms_json AS JSON) AS VARCHAR[])
      WHEN json_type(synonyms_json) = 'VARCHAR' THEN [json_extract_string(synonyms_json, '$')] ELSE [] END AS syn
    FROM ols_terms WHERE synonyms_json IS NOT NULL))"""
