"""What callers receive: mappings with candidates, event lines, the legacy report, flat rows and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import evidence as ev
from termweave.operators.rules import chain_of
from termweave.skew import ordered_positions

# The columns of the legacy report, its study, and the mark of a property without candidates.
REPORT_COLUMNS = ("PROPERTY TYPE", "PROPERTY VALUE", "ONTOLOGY TERM LABEL(S)", "CONFIDENCE", "ONTOLOGY TERM(S)", "ONTOLOGY(S)", "SOURCE(S)", "STUDY")
NO_STUDY = "[UNKNOWN EXPERIMENTS]"
NOT_MAPPED = "Did not map"


def candidate(e: DataFrame) -> Column:
    return F.struct(
        F.col("term_id").alias("termId"), "label", "ontology", F.col("iri").alias("uri"), "confidence", "datasource", F.coalesce("preferred", F.lit(False)).alias("preferred"),
        chain_of(e).alias("mappingProvenance"), F.coalesce("supporting", F.array().cast(f"array<array<{ev.STEP}>>")).alias("supportingProvenance"),
    )


def mappings(properties: DataFrame, results: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """One row per property, candidates in rank order (empty if it did not map), with the first error, the distinct warnings and whether a warning says the search was cut short.

    properties: prop_id, property_type, text. results: reduced evidence with ``place``. diagnostics: prop_id, seq, error, warning. A property's candidates
    are at most the vocabulary's terms, after the rules usually a few.
    """
    r = results.join(properties.select("prop_id", "text"), "prop_id")
    ranked = r.groupBy("prop_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", candidate(r).alias("c")))), lambda s: s["c"]).alias("candidates"))
    out = properties.join(ranked, "prop_id", "left")
    if diagnostics is None:
        out = out.withColumn("error", F.lit(None).cast("string")).withColumn("warnings", F.lit(None).cast("array<string>")).withColumn("truncated", F.lit(None).cast("boolean"))
    else:
        d = diagnostics.groupBy("prop_id", "warning").agg(F.min("seq").alias("seq"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error"))
        notes = F.transform(F.array_sort(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct("seq", "warning")))), lambda s: s["warning"])
        d = d.groupBy("prop_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error"), F.when(F.size(notes) > 0, notes).alias("warnings"), F.when(F.bool_or(F.startswith("warning", F.lit("truncated"))), True).alias("truncated"))
        out = out.join(d, "prop_id", "left")
    empty = F.array().cast(out.schema["candidates"].dataType)
    return out.select("prop_id", "property_type", "text", F.coalesce("candidates", empty).alias("candidates"), "error", "warnings", "truncated")


def as_json(mapped: DataFrame) -> DataFrame:
    """One JSON text per property."""
    return mapped.select("prop_id", F.to_json(F.struct(F.col("property_type").alias("propertyType"), F.col("text").alias("textToMap"), "candidates", "error", "warnings", "truncated")).alias("body"))


def write_events(mapped: DataFrame, path: str) -> None:
    """Result events as newline-delimited JSON."""
    mapped.select(F.lit("result").alias("event"), F.col("property_type").alias("propertyType"), F.col("text").alias("textToMap"), "candidates", "error").write.mode("overwrite").json(path)


def event_rows(mapped: DataFrame, order: str) -> DataFrame:
    """The events of one stream: a result for every row, numbered in order (``completed`` of ``total``), then "done"; ``order`` is unique. No task holds all rows."""
    total = F.broadcast(mapped.agg(F.count(F.lit(1)).alias("total")))  # one row
    placed = ordered_positions(mapped.withColumn("_all", F.lit(0)), "_all", [F.col(order).asc()], "completed").drop("_all")
    done = mapped.agg(F.count(F.lit(1)).alias("total")).select(F.lit("done").alias("type"), F.col("total").alias("completed"), "total")
    return placed.withColumn("type", F.lit("result")).crossJoin(total).unionByName(done, allowMissingColumns=True)


def flat(mapped: DataFrame) -> DataFrame:
    """One row per candidate, or one placeholder for a property with an error or without candidates."""
    each = mapped.select("prop_id", "property_type", "text", "error", F.posexplode_outer("candidates").alias("place", "c"))
    none = F.coalesce("error", F.when(F.col("c").isNull(), F.lit(NOT_MAPPED)))
    return each.select("prop_id", "property_type", "text", "place", F.col("c.label").alias("label"), F.col("c.confidence").alias("confidence"), F.col("c.termId").alias("term_id"), F.col("c.uri").alias("uri"), F.col("c.ontology").alias("ontology"), F.col("c.datasource").alias("datasource"), none.alias("note"))


def semantic_tag(steps: Column, term_id: Column) -> Column:
    """The target of the last step that has one, else the term's id."""
    aims = F.filter(F.transform(steps, lambda s: s["target"]), lambda t: t.isNotNull() & (F.trim(t) != ""))
    return F.coalesce(F.try_element_at(aims, F.lit(-1)), term_id)


def report_lines(flat_rows: DataFrame, run_at: str, application: str = "termweave") -> DataFrame:
    """The legacy tab-separated report: ord, line. Four lines of heading, a gap, the column names, then one line per result in order of property and rank."""
    spark = flat_rows.sparkSession
    head = [f"Application Name:\t{application}", "Version:\t2.0", f"Run at:\t{run_at}", "Run from:\tlocal", "", "", "\t".join(REPORT_COLUMNS)]
    top = spark.createDataFrame([(-1, i, x) for i, x in enumerate(head)], "prop_id long, place int, line string")
    text = lambda c: F.coalesce(c, F.lit(""))
    level = F.initcap(F.lower(ev.level(F.col("confidence"))))
    rows = flat_rows.filter("term_id is not null").select(
        "prop_id", "place", F.concat_ws("\t", text(F.col("property_type")), text(F.col("text")), text(F.col("label")), level, F.col("term_id"), text(F.col("ontology")), text(F.col("datasource")), F.lit(NO_STUDY)).alias("line"),
    )
    return top.unionByName(rows)


def entity_uri(base: str, source: Column, name: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), source, F.lit("/"), F.upper(F.md5(F.concat(source, F.lit(":"), name))))


def annotation_json(rows: DataFrame, base: str, link_base: str, now_ms: int) -> DataFrame:
    """The legacy annotation: an inferred wrapper around the raw one, with links and biological entities. rows: flat evidence with iri, kind, study, bioentity."""
    tags = F.array("iri")
    links = F.struct(F.array(F.struct(F.concat(F.lit(link_base), F.url_encode("iri")).alias("href"), F.col("iri").alias("semanticTag"))).alias("links"))
    prop = F.struct(F.lit(None).cast("string").alias("uri"), F.col("property_type").alias("propertyType"), F.col("text").alias("propertyValue"))
    study = F.when(F.col("study").isNotNull(), F.array(F.struct(entity_uri(base, F.col("datasource"), F.col("study")).alias("uri"), F.col("study").alias("accession"))))
    entity = F.when(F.col("bioentity").isNotNull(), F.array(F.struct(entity_uri(base, F.col("datasource"), F.col("bioentity")).alias("uri"), F.col("bioentity").alias("name"), study.alias("studies"))))
    source = F.struct(F.struct(F.lit("DATABASE").alias("type"), F.col("datasource").alias("name")).alias("source"), F.col("kind").alias("evidence"))
    raw = F.struct(tags.alias("semanticTags"), prop.alias("annotatedProperty"), entity.alias("annotatedBiologicalEntities"), links.alias("_links"), source.alias("provenance"))
    own = F.struct(F.lit("INFERRED_FROM_CURATED").alias("evidence"), F.lit(now_ms).alias("generatedDate"))
    level = ev.level(F.col("confidence"), ev.tier_of(F.col("kind")))
    return rows.select("prop_id", F.to_json(F.struct(tags.alias("semanticTags"), level.alias("confidence"), prop.alias("annotatedProperty"), links.alias("_links"), own.alias("provenance"), raw.alias("derivedFrom"))).alias("body"))
