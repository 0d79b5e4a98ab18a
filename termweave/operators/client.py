"""What a client does with results, and what it asks of the service besides mapping: orders, pages, overrides, lookups, listings."""

from __future__ import annotations

import gzip
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.functions import ids
from termweave.skew import ordered_positions

# Fixed value: the place of a result that no input asked for.
NO_PLACE = 9999
# Columns of a client's table of results.
TABLE_COLUMNS = ("textToMap", "propertyType", "ontologyTermLabel", "ontologyTermID", "ontologyURI", "mappingConfidence", "datasource")


def same_key(left: list[str], right: list[str]) -> Column:
    """Whether two rows have one key: null and '' are the same."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(x), F.lit("")) == F.coalesce(F.col(y), F.lit("")) for x, y in zip(left, right)))


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """The frame's distinct keys under names of their own."""
    names = [f"_{k}" for k in keys]
    return df.select(*(F.coalesce(F.col(k), F.lit("")).alias(n) for k, n in zip(keys, names))).distinct(), names


def in_progress(inputs: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """The inputs that no returned row answers; null and '' are the same in a key."""
    known, names = _keyed(returned, keys)
    return inputs.join(known, same_key(keys, names), "left_anti")


def split_by(rows: DataFrame, column: str, fixtures: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose text is a fixture's whatever the case, the others)."""
    known = fixtures.filter(F.col(value).isNotNull()).select(F.lower(value).alias("_low")).distinct()
    on = F.lower(column) == F.col("_low")
    return rows.join(known, on, "left_semi"), rows.join(known, on, "left_anti")


def in_input_order(results: DataFrame, inputs: DataFrame, keys: list[str], at: str, tie: str, out: str = "place") -> DataFrame:
    """Results numbered from 1 in the order of the inputs (by the first place ``at`` of their key, else NO_PLACE), then by ``tie``, which is unique; no task holds them all."""
    known, names = _keyed(inputs, keys)
    first = inputs.groupBy(*(F.coalesce(F.col(k), F.lit("")).alias(n) for k, n in zip(keys, names))).agg(F.min(at).alias("_at"))
    placed = results.join(first, same_key(keys, names), "left").drop(*names).withColumn("_at", F.coalesce("_at", F.lit(NO_PLACE))).withColumn("_all", F.lit(0))
    return ordered_positions(placed, "_all", [F.col("_at").asc(), F.col(tie).asc()], out).drop("_all", "_at")


def page(placed: DataFrame, number: int, size: int, place: str = "place") -> DataFrame:
    """Page ``number`` (from 0) of numbered rows."""
    return placed.filter((F.col(place) > number * size) & (F.col(place) <= (number + 1) * size))


def overridden(rows: DataFrame, overrides: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with the columns of the override of their key, where there is one. Overrides have one row per key."""
    names = [f"_{k}" for k in keys]
    other = overrides.select(*(F.coalesce(F.col(k), F.lit("")).alias(n) for k, n in zip(keys, names)), F.lit(True).alias("_is"), *(F.col(c).alias(f"_to_{c}") for c in columns))
    out = rows.join(other, same_key(keys, names), "left")
    return out.select(*(F.when(F.col("_is"), F.col(f"_to_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def visible(rows: DataFrame, approved: DataFrame, removed: DataFrame, of: list[str], term: str) -> DataFrame:
    """Rows that were not removed; where a property has an approved row, only its approved ones. Keys are the property's columns and the term."""
    keys = [*of, term]
    gone, names = _keyed(removed, keys)
    rows = rows.join(gone, same_key(keys, names), "left_anti")
    fit, names = _keyed(approved, keys)
    some, own = _keyed(approved, of)
    rows = rows.join(fit.withColumn("_fit", F.lit(True)), same_key(keys, names), "left").drop(*names)
    rows = rows.join(some.withColumn("_some", F.lit(True)), same_key(of, own), "left").drop(*own)
    return rows.filter("_fit is not null or _some is null").drop("_fit", "_some")


def merged_alternatives(existing: DataFrame, fetched: DataFrame, of: str, term: str, score: str, tie: str, out: str = "place") -> DataFrame:
    """Existing rows and the fetched ones whose term the property does not have yet, numbered by score, the highest first."""
    known, names = _keyed(existing, [of, term])
    more = fetched.join(known, same_key([of, term], names), "left_anti")
    return ordered_positions(existing.unionByName(more), of, [F.col(score).desc_nulls_last(), F.col(tie).asc()], out)


def row_class(score: Column, error: Column) -> Column:
    # Classes of a client's rows.
    return F.when(error.isNotNull() & (error != ""), "error-row").when(score.isNull() | F.isnan(score), "unmapped").when(score >= 0.9, "automatic").when(score < 0.2, "low-score").otherwise("curation")


def percent(score: Column) -> Column:
    """A score as a percentage with two places; null and NaN give ''."""
    return F.when(score.isNull() | F.isnan(score), "").otherwise(F.format_string("%.2f%%", score * 100))


def shown_id(short: Column) -> Column:
    """A short form with the underscore before its number as a colon."""
    return F.regexp_replace(F.coalesce(short, F.lit("")), r"\A(.*?)_(\d)", "$1:$2")


def lookup(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """iri, state of each wanted IRI: complete, incomplete (an obsolete term without a replacement or notes, or of unknown state), missing. terms has iri, obsolete, replaced_by, noted."""
    complete = F.col("obsolete").isNotNull() & (~F.col("obsolete") | F.col("replaced_by").isNotNull() | F.col("noted"))
    known = terms.select("iri", F.when(F.coalesce(complete, F.lit(False)), "complete").otherwise("incomplete").alias("state"))
    return wanted.filter("iri is not null").select("iri").distinct().join(known, "iri", "left").select("iri", F.coalesce("state", F.lit("missing")).alias("state"))


def cached(requests: DataFrame, stored: DataFrame, keys: list[str], body: str, age: str, since: Column) -> DataFrame:
    """Requests that a stored answer, not older than ``since``, has the keys and body of; a missing body is an empty one."""
    names = [f"_{k}" for k in (*keys, body)]
    answers = stored.filter(F.col(age) >= since).select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.coalesce(F.col(body), F.lit("")).alias(names[-1])).distinct()
    on = reduce(lambda a, b: a & b, (F.col(k) == F.col(n) for k, n in zip(keys, names)))
    return requests.join(answers, on & (F.coalesce(F.col(body), F.lit("")) == F.col(names[-1])), "left_semi")


def with_uri(rows: DataFrame, name: str, sources: DataFrame, out: str = "uri") -> DataFrame:
    """The URI of each named source, whatever the case (of several the first by ord); a name without one is its own. sources: ord, name, uri; configuration, one row per source."""
    known = sources.groupBy(F.lower("name").alias("_low")).agg(F.min_by("uri", "ord").alias("_uri"))
    return rows.join(known, F.lower(name) == F.col("_low"), "left").withColumn(out, F.coalesce("_uri", name)).drop("_low", "_uri")


def presets(given: DataFrame, column: str, ids_: DataFrame, id_col: str) -> DataFrame:
    """Presets with all further ids behind their own, none twice. The ids are configuration: one per ontology."""
    every = ids_.agg(F.array_sort(F.collect_set(id_col)).alias("_ids"))
    return given.crossJoin(F.broadcast(every)).withColumn(column, F.array_union(F.coalesce(column, F.array().cast("array<string>")), "_ids")).drop("_ids")


def default_model(models: DataFrame) -> DataFrame:
    """Models with whether each is the default: the first by ord that can embed. models: ord, model, can_embed; a listing, at most some hundred rows."""
    first = models.filter("can_embed").agg(F.min_by("model", "ord").alias("_first"))
    return models.crossJoin(F.broadcast(first)).withColumn("is_default", F.coalesce(F.col("model") == F.col("_first"), F.lit(False))).drop("_first")


def short_forms(terms: DataFrame, ontologies: DataFrame) -> DataFrame:
    """terms (iri, ontology) with short_form as the ontology's configuration gives it.

    ontologies: ontology, preferred (prefix, or null: the name in capitals), bases (array, or null). The longest base that the IRI starts with is
    exchanged for the prefix and an underscore; "urn:" is cut off; else the local part stays.
    """
    config = ontologies.select(F.col("ontology").alias("_o"), F.coalesce(F.when(~ids.blank(F.col("preferred")), F.col("preferred")), F.upper("ontology")).alias("_p"), F.coalesce("bases", F.array().cast("array<string>")).alias("_b"))
    t = terms.join(config, F.col("ontology") == F.col("_o"), "left")
    fit = F.filter("_b", lambda b: (b != "") & F.startswith(F.col("iri"), b))
    longest = F.element_at(F.reverse(F.array_sort(F.transform(fit, lambda b: F.struct(F.length(b).alias("n"), b.alias("b"))))), 1)["b"]
    longest = F.when(F.size(fit) > 0, longest)
    short = F.when(F.startswith(F.col("iri"), F.lit("urn:")), F.expr("substring(iri, 5)")).when(longest.isNotNull(), F.concat("_p", F.lit("_"), F.expr("substring(iri, _n + 1)")))
    return t.withColumn("_n", F.length(longest)).withColumn("short_form", F.coalesce(short, F.nullif(ids.local_part(F.col("iri")), F.lit("")))).drop("_o", "_p", "_b", "_n")


@F.arrow_udf(T.BinaryType())
def packed(texts: pa.Array) -> pa.Array:
    """Texts compressed; null stays null."""
    return pa.array([None if t is None else gzip.compress(t.encode(), mtime=0) for t in texts.to_pylist()], pa.binary())


@F.arrow_udf(T.StringType())
def unpacked(stored: pa.Array) -> pa.Array:
    """Stored texts, compressed or plain."""

    def text(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return gzip.decompress(b).decode("utf-8", "replace") if b[:2] == b"\x1f\x8b" else b.decode("utf-8", "replace")
        except OSError:
            return b.decode("utf-8", "replace")

    return pa.array([text(b) for b in stored.to_pylist()], pa.string())


def describe(error: BaseException | None) -> str:
    """An error's kind, and its message if it has one."""
    if error is None:
        return "unknown error"
    kind, message = type(error).__name__, str(error)
    return f"{kind}: {message}" if message.strip() else kind


def best_per_text(parts: DataFrame, text: str, score: str) -> DataFrame:
    """The highest score of each text."""
    return parts.groupBy(text).agg(F.max(score).alias(score))


def first_spelling(rows: DataFrame, of: str, text: str, order: str) -> DataFrame:
    """Of texts that differ in case alone the first one's spelling."""
    w = Window.partitionBy(of, F.lower(text)).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
