"""Search for terms by words and spelling and by vectors, within the ontologies that a request names.

The remote search's relevance order cannot be had from tables. Its stand-in ranks whole matches first (label, then synonym), then names that hold all
content words of the text, the tightest first, then the most similar; ties go to the smaller IRI. Terms are found by joins on equal names, on
a text's rarest content word, and on the rare prefixes of word and trigram sets, never by comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import evidence as ev
from termweave.functions import ids
from termweave.functions import similarity as sim
from termweave.operators import channels
from termweave.plans.filters import Filter
from termweave.session import cut_lineage, small_side

#: Results of one search: by words, by vectors at first, by vectors when searched deeply, and terms near a term.
LEXICAL, SHALLOW, DEEP, SIMILAR = 20, 10, 100, 50
#: Least similarity of a vector hit, and most ontologies that are searched one by one.
LEAST_VECTOR, MOST_SCOPED = 0.7, 5
#: Least Jaccard similarity of the words, or of the trigrams, of a text and a name that are compared.
LEAST_WORDS, LEAST_TRIGRAMS = 0.5, 0.4


def names_of(terms: DataFrame) -> DataFrame:
    """iri, short_form, ontology, ord (0 is the label), name of every label and synonym."""
    return terms.select("iri", "short_form", "ontology", F.posexplode(F.concat(F.array("label"), "synonyms")).alias("ord", "name")).filter("iri is not null and name is not null")


def alike(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text, name of every pair of distinct strings that share enough words or enough trigrams; what shares enough of both comes twice."""
    t, n = texts.select(F.col("text").alias("l")).distinct(), names.select(F.col("name").alias("r")).distinct()
    pairs = None
    for sets, least in ((sim.tokens, LEAST_WORDS), (sim.trigrams, LEAST_TRIGRAMS)):
        found = channels.set_join(t.select("l", sets(F.col("l")).alias("g")), n.select("r", sets(F.col("r")).alias("g")), least).select(F.col("l").alias("text"), F.col("r").alias("name"))
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs


def scored_terms(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text, iri, short_form, ontology, same (2 label, 1 synonym, 0 neither), n and held (words and text of the tightest name that holds the text, else null), best (similarity of the best name, and that name).

    One row per text and term that any of the joins finds; null and blank texts give none.
    """
    texts = texts.filter("trim(text) <> ''").select("text").distinct()
    known = cut_lineage(names.withColumn("low", F.lower("name")))
    same = texts.withColumn("low", F.lower("text")).join(small_side(known.select("low", "iri"), of=known), "low").select("text", "iri")
    held = channels.holders(texts, known).select("text", "iri")
    near = alike(texts, known).join(small_side(known.select("name", "iri"), of=known), "name").select("text", "iri")
    # A text has no more pairs than there are terms; rows that lie by text need no further exchange here or where they are ranked. Pairs are short and dear to
    # score: with a number given they are not packed into a few tasks by their bytes.
    pairs = same.unionByName(held).unionByName(near).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "text").distinct()
    both = pairs.join(small_side(known), "iri")
    equal = F.when(F.col("low") == F.lower("text"), F.when(F.col("ord") == 0, 2).otherwise(1)).otherwise(0)
    words = sim.content_tokens(F.col("name"))
    inside = F.when(sim.contains_all(sim.content_tokens(F.col("text")), words), F.struct(F.size(words).alias("n"), "ord", "name"))
    like = F.struct(sim.blended(F.col("text"), F.col("name")).alias("score"), (-F.col("ord")).alias("o"), "name")
    return both.groupBy("text", "iri", "short_form", "ontology").agg(F.max(equal).alias("same"), F.min(inside).alias("in"), F.max(like).alias("like")).select(
        "text", "iri", "short_form", "ontology", "same", F.col("in.n").alias("n"), F.col("in.name").alias("held"), F.col("like").alias("best")
    )


def lexical(texts: DataFrame, terms: DataFrame, f: Filter = Filter(), k: int = LEXICAL) -> DataFrame:
    """text, iri, term_id, ontology, kind, confidence, matched: the terms that searching for each text finds, scored by their class.

    With targets the search also runs within them; where no other ontology may answer only that one runs. Containment is scored
    against the tightest holder found, of the targets' own terms if only those count and there is one.
    """
    found = scored_terms(texts, names_of(terms))
    order = [F.col("same").desc(), F.when(F.col("same") == 0, F.col("n")).asc_nulls_last(), F.round("best.score", 9).desc(), F.col("iri").asc()]
    inside = F.coalesce(F.lower("ontology").isin(f.low_targets), F.lit(False)) if f.targets else F.lit(False)
    found = found.withColumn("_in", inside)
    place = F.row_number().over(Window.partitionBy("text").orderBy(*order)) <= k
    if f.targets:
        scoped = F.col("_in") & (F.row_number().over(Window.partitionBy("text", "_in").orderBy(*order)) <= k)
        found = found.withColumn("_keep", scoped if f.hard else scoped | place).filter("_keep")
    else:
        found = found.withColumn("_place", F.row_number().over(Window.partitionBy("text").orderBy(*order))).filter(F.col("_place") <= k)
    w = Window.partitionBy("text")
    tightest = F.min("n").over(w)
    if f.defining_only and f.targets:
        own = ids.in_namespaces(F.when(ids.blank(F.col("short_form")), F.col("iri")).otherwise(F.col("short_form")), f.low_targets)
        tightest = F.coalesce(F.min(F.when(own, F.col("n"))).over(w), tightest)
    kind = (
        F.when(F.col("same") == 2, "OLS_LEXICAL_FUZZY_LABEL").when(F.col("same") == 1, "OLS_LEXICAL_FUZZY_SYNONYM").when(F.col("n").isNotNull(), "OLS_LEXICAL_CONTAINED").otherwise("OLS_LEXICAL_FUZZY")
    )
    score = F.when(F.col("n").isNotNull(), sim.containment_score(F.col("_tightest"), F.col("n")))
    confidence = F.when(F.col("kind") == "OLS_LEXICAL_FUZZY", ev.FUZZY_WEIGHT * F.col("best.score")).otherwise(ev.tier_confidence(ev.tier_of(F.col("kind")), score))
    found = found.withColumn("_tightest", tightest).withColumn("kind", kind)
    return found.select("text", "iri", F.col("short_form").alias("term_id"), "ontology", "kind", confidence.alias("confidence"), F.when(F.col("kind") == "OLS_LEXICAL_CONTAINED", F.col("held")).otherwise(F.col("best.name")).alias("matched"))


def casings(texts: DataFrame) -> DataFrame:
    """text, casing, turn: a text as it is and, if that differs, in small letters."""
    return texts.select("text", F.posexplode(F.array_distinct(F.array("text", F.lower("text")))).alias("turn", "casing"))


def merged_hits(hits: DataFrame) -> DataFrame:
    """text, iri, score of the hits of several searches (text, iri, score, turn): the highest score of each term, of equal ones that of the earlier search. Hits without a score or IRI, or under LEAST_VECTOR, are left out."""
    fit = hits.filter(F.col("iri").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") >= LEAST_VECTOR))
    return fit.groupBy("text", "iri").agg(F.min_by(F.struct("score", "turn"), F.struct((-F.col("score")).alias("s"), "turn")).alias("b")).select("text", "iri", "b.score", "b.turn")


def by_vectors(texts: DataFrame, text_vectors: DataFrame, term_vectors: DataFrame, f: Filter = Filter(), k: int = SHALLOW) -> DataFrame:
    """text, iri, score, turn: for each text the k nearest term vectors of every search that the request asks for, merged by term.

    text_vectors: id, text, vector; term_vectors: id, iri, ontology, vector. Both casings of a text are searched, over all terms and within each
    target one by one; where no other ontology may answer only the latter. Of more than MOST_SCOPED targets none is searched by itself.
    """
    scoped = list(dict.fromkeys(f.low_targets)) if len(set(f.low_targets)) <= MOST_SCOPED else []
    # The query of a casing is the vector of that spelling.
    asked = casings(texts).join(text_vectors.select(F.col("text").alias("casing"), F.col("id").alias("query_id"), "vector"), "casing")
    asked = cut_lineage(asked.select("text", "turn", "query_id", "vector"))
    queries = asked.select("query_id", "vector").dropDuplicates(["query_id"])
    hits = None
    for i, ontology in enumerate(([] if f.hard and scoped else [None]) + scoped):
        base = term_vectors if ontology is None else term_vectors.filter(F.lower("ontology") == ontology)
        near = channels.nearest_vectors(queries, base.select("id", "vector"), k).select("query_id", "id", F.col("similarity").alias("score"), F.lit(i).alias("call"))
        hits = near if hits is None else hits.unionByName(near)
    hits = hits.join(term_vectors.select("id", "iri"), "id").join(asked.select("query_id", "text", "turn"), "query_id")
    return merged_hits(hits.select("text", "iri", "score", (F.col("turn") * 100 + F.col("call")).alias("turn")))


def unseen(deep: DataFrame, shallow: DataFrame) -> DataFrame:
    """The deep hits (text, iri, score) whose term the shallow ones lack or score lower."""
    seen = shallow.groupBy("text", "iri").agg(F.max("score").alias("_seen"))
    return deep.join(seen, ["text", "iri"], "left").filter("_seen is null or score > _seen").drop("_seen")


def similar_terms(iris: DataFrame, term_vectors: DataFrame, k: int = SIMILAR) -> DataFrame:
    """iri, other, similarity: the terms of the k vectors nearest to each given term's own (its smallest id)."""
    own = term_vectors.join(iris.select("iri").distinct(), "iri").groupBy("iri").agg(F.min_by(F.struct("id", "vector"), "id").alias("v"))
    seeds = cut_lineage(own.select("iri", F.col("v.id").alias("query_id"), F.col("v.vector").alias("vector")))
    near = channels.nearest_vectors(seeds.select("query_id", "vector"), term_vectors.select("id", "vector"), k)
    named = near.join(term_vectors.select("id", F.col("iri").alias("other")), "id").join(seeds.select("iri", "query_id"), "query_id")
    return named.groupBy("iri", "other").agg(F.max("similarity").alias("similarity"))


def expansion_open(seeds: DataFrame, targets: list[str], column: Column) -> DataFrame:
    """prop_id of the properties none of whose seeds is from a target by ``column`` (a source's name or a namespace); none without targets."""
    if not targets:
        return seeds.select("prop_id").limit(0)
    return seeds.groupBy("prop_id").agg(F.bool_or(F.coalesce(F.lower(column).isin(targets), F.lit(False))).alias("has")).filter("not has").select("prop_id")
