"""The prefix registry: from full identifiers to compact ones and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import ids
from termweave.session import small_side


def registry_index(registry: DataFrame) -> DataFrame:
    """key, prefix, base, pattern: every canonical, preferred and synonym prefix in its comparing form; of entries that share one the last (by ``ord``) wins.

    registry has ord, prefix, preferred_prefix, synonyms, uri_format (with $1), pattern.
    """
    names = F.array_union(F.array("prefix", "preferred_prefix"), F.coalesce("synonyms", F.array().cast("array<string>")))
    rows = registry.select("ord", "prefix", F.regexp_replace("uri_format", r"\$1\z", "").alias("base"), "pattern", F.explode(F.array_compact(names)).alias("name"))
    return rows.withColumn("key", ids.normal_prefix(F.col("name"))).groupBy("key").agg(F.max_by(F.struct("prefix", "base", "pattern"), "ord").alias("e")).select("key", "e.*")


def longest_prefix(iris: DataFrame, iri: str, registry: DataFrame) -> DataFrame:
    """Add prefix, base: the registry entry with the longest base that the IRI starts with; null if there is none.

    Bases end in a slash, hash or underscore, so an IRI is cut at each of these and equi-joined: no comparison of every IRI with every base.
    """
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(iri), F.lit(1))), lambda i: F.when(F.substring(F.col(iri), i, F.lit(1)).isin("/", "#", "_", "="), F.substring(F.col(iri), F.lit(1), i)))
    known = small_side(registry.select("prefix", F.regexp_replace("uri_format", r"\$1\z", "").alias("base")).dropDuplicates(["base"]))
    each = iris.select(iri).distinct().select(iri, F.explode(F.array_compact(cuts)).alias("base")).join(known, "base")
    best = each.groupBy(iri).agg(F.max_by(F.struct("prefix", "base"), F.length("base")).alias("b")).select(iri, "b.*")
    return iris.join(best, iri, "left")


def expand(df: DataFrame, short: str, index: DataFrame, out: str = "iri") -> DataFrame:
    """Add the full identifier of a short form or compact id: split at a colon, or at every underscore from the last; the first split whose
    prefix is known and whose pattern, if any, matches the whole local part. A full identifier stays; what cannot be expanded stays as it is.
    """
    text = F.col(short)
    places = F.filter(F.sequence(F.lit(2), F.greatest(F.length(text), F.lit(2))), lambda i: F.substring(text, i, F.lit(1)) == F.when(text.contains(":"), ":").otherwise("_"))
    split = F.transform(F.reverse(places), lambda i: F.struct(ids.normal_prefix(F.substring(text, F.lit(1), i - 1)).alias("key"), F.substring(text, i + 1, F.length(text)).alias("local")))
    tries = df.select(short).distinct().filter(~text.rlike(r"\Ahttps?://")).select(short, F.posexplode(split).alias("at", "_split")).select(short, "at", "_split.*")
    hits = tries.join(small_side(index), "key").filter(F.col("pattern").isNull() | F.expr("regexp_like(local, concat('\\\\A(?:', pattern, ')\\\\z'))"))
    best = hits.groupBy(short).agg(F.min_by(F.concat("base", "local"), "at").alias("_iri"))
    return df.join(best, short, "left").withColumn(out, F.coalesce("_iri", short)).drop("_iri")


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; the group limit keeps a hot key from being gathered."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
