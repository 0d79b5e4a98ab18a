"""Obsolete terms and the chains of their replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Replacements that are followed before a chain is given up.
HOPS = 5


def is_obsolete(flag: Column, label: Column) -> Column:
    """By its flag, or by a label that says so."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.lower(label).startswith("obsolete"), F.lit(False))


def resolve_chains(terms: DataFrame, hops: int = HOPS) -> DataFrame:
    """origin, iri, hops, trail: the live term that each obsolete term's chain of replacements ends in, after at most ``hops`` steps, and the terms passed (iri, label, ontology) from the origin on.

    Chains that cycle, break off or go on longer give no row. terms has iri, label, obsolete, replaced_by and may have ontology; iri is unique and nulls are ignored.
    Unrolled equi-joins on the shrinking set of unresolved chains; only obsolete terms are walked.
    """
    ontology = F.col("ontology") if "ontology" in terms.columns else F.lit(None).cast("string")
    here = F.struct("iri", "label", ontology.alias("ontology"))
    known = terms.filter("iri is not null").select("iri", is_obsolete(F.col("obsolete"), F.col("label")).alias("dead"), F.col("replaced_by").alias("next"), here.alias("here"))
    walk = known.filter("dead").select(F.col("iri").alias("origin"), F.array("here").alias("trail"), "next")
    out = None
    for hop in range(1, hops + 1):
        new = F.col("next").isNotNull() & ~F.exists("trail", lambda t: t["iri"] == F.col("next"))
        step = walk.filter(new).withColumnRenamed("next", "iri").join(known, "iri").withColumn("trail", F.array_append("trail", F.col("here")))
        done = step.filter("not dead").select("origin", "iri", F.lit(hop).alias("hops"), "trail")
        out = done if out is None else out.unionByName(done)
        walk = step.filter("dead").select("origin", "trail", "next")
    return out
