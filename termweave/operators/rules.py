"""The rules that turn evidence into a result: filters, priors, corroboration, pruning, one row per term, ranking.

Evidence has one row per match: prop_id, seq (its place, the last tie-breaker), term_id, iri, label, ontology, confidence, kind (of match),
datasource, property_type, and it may have chain, its steps of provenance. prop_id is never null. Every rule is DataFrame to DataFrame. What a rule
needs to know of a whole property (maxima, flags) is aggregated, combined before the shuffle, and joined back by plain equality, so that the
aggregate and the join share a partitioning. No rule gathers a property's rows in one task: where a join ends a plan AQE splits a hot property,
and where more follows its rows are salted (``hot_properties``). Once rows are reduced to terms a property has at most the vocabulary's
terms, and windows take over. Comparisons use raw doubles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import evidence as ev
from termweave.functions import ids
from termweave.plans.filters import Filter
from termweave.session import cut_lineage
from termweave.skew import HOT_KEYS, HOT_ROWS

# Fixed values of the rules.
WEAK_BEST, WEAK_GAP, TARGET_GAP, EMBEDDING_GAP = 0.7, 0.2, 0.05, 0.005
BONUS, LEAST_SUPPORT, PRIOR = 0.02, 0.5, 0.1
#: A list of priors is configuration; more than this is a mistake.
MAX_PRIORS = 1_000


def classify(evidence: DataFrame) -> DataFrame:
    """Add method, tier, rank and the term key. Rows without a term key are kept until rows are reduced to terms."""
    e = evidence.withColumn("method", ev.method_of(F.col("kind"))).withColumn("tier", ev.tier_of(F.col("kind")))
    return e.withColumn("rank", ev.evidence_rank(F.col("kind"), F.col("tier"))).withColumn("term_key", F.coalesce("iri", "term_id"))


def with_stats(df: DataFrame, keys: list[str], hot: DataFrame | None = None, near: bool = False, **stats: Column) -> DataFrame:
    """Join each group's aggregates to its rows; rows with a null key get null aggregates. ``hot`` has prop_id and salts of the properties that are to be split.
    ``near``: no key is null and groups are small, so that a window does it without moving rows again."""
    if near:
        w = Window.partitionBy(*keys)
        return df.select("*", *(c.over(w).alias(n) for n, c in stats.items()))
    gone = [f"_{k}" for k in keys]
    grouped = df.groupBy(*(F.col(k).alias(g) for k, g in zip(keys, gone))).agg(*(c.alias(n) for n, c in stats.items()))
    on = reduce(lambda a, b: a & b, (F.col(k) == F.col(g) for k, g in zip(keys, gone)))
    if hot is None:
        return df.join(grouped, on, "left").drop(*gone)
    salted = df.join(F.broadcast(hot), "prop_id", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("seq"), F.col("salts")), F.lit(0))).drop("salts")
    copies = grouped.join(F.broadcast(hot.withColumnRenamed("prop_id", "_hot")), F.col(gone[0]) == F.col("_hot"), "left").drop("_hot")
    copies = copies.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("salts") - 1, F.lit(0).cast("long"))))).drop("salts")
    return salted.join(copies, on & (F.col("_salt") == F.col("_s")), "left").drop(*gone, "_s", "_salt")


def hot_properties(df: DataFrame) -> DataFrame | None:
    """prop_id, salts of the properties with more than max(HOT_ROWS, 1/HOT_KEYS of all) rows; None if there are none. At most HOT_KEYS rows reach the driver."""
    total = df.count()
    if total <= HOT_ROWS:
        return None
    limit = max(HOT_ROWS, total // HOT_KEYS)
    sizes = df.groupBy("prop_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    found = sizes.select("prop_id", F.ceil(F.col("n") / limit).alias("salts")).collect()
    return df.sparkSession.createDataFrame(found, sizes.select("prop_id", F.lit(1).cast("long").alias("salts")).schema) if found else None


def exclude_terms(df: DataFrame, excluded: list[str]) -> DataFrame:
    """Drop terms that any of the ids names, in any comparison form of either side."""
    given = [x for x in excluded if x and x.strip()]
    if not given:
        return df
    forms = sorted(set().union(*(ids.forms_of(x) for x in given)))
    return df.filter(~ids.is_one_of(F.col("term_id"), F.col("iri"), forms))


def required_sources(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Only curated rows are held to the required sources; a curated row without a source is dropped."""
    if not required:
        return df
    curated = F.coalesce(ev.method_of(F.col("kind")) == "curated", F.lit(False))
    return df.filter(~curated | F.coalesce(F.lower("datasource").isin([r.lower() for r in required]), F.lit(False)))


def hard_ontologies(df: DataFrame, f: Filter) -> DataFrame:
    return df.filter(ids.target_of(F.col("ontology"), F.col("term_id"), f.low_targets).isNotNull()) if f.hard else df


def defining_only(df: DataFrame, f: Filter) -> DataFrame:
    """Keep terms whose own namespace is a target; a term without a prefix falls back to the ontology that holds it. Without targets nothing is dropped."""
    if not (f.defining_only and f.targets):
        return df
    return df.filter(F.coalesce(ids.prefix_of(F.col("term_id")), F.lower("ontology")).isin(f.low_targets))


def type_tokens(text: Column) -> Column:
    return F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " "))


def read_priors(priors: DataFrame) -> list[tuple[str, list[str], list[str]]]:
    """(type phrase, namespaces, excluded words) from configuration (at most MAX_PRIORS rows, else an error)."""
    rows = priors.select("type_name", "namespaces", "excluded").filter("type_name is not null and namespaces is not null").limit(MAX_PRIORS + 1).collect()
    if len(rows) > MAX_PRIORS:
        raise ValueError(f"more than {MAX_PRIORS} priors")
    return [(r[0], list(r[1]), list(r[2] or [])) for r in rows]


def preferred_namespaces(property_type: Column, priors: list[tuple[str, list[str], list[str]]]) -> Column:
    """Namespaces that a property type asks for: of every phrase all of whose words it has, and none of whose excluded words."""
    words = type_tokens(property_type)
    parts = []
    for phrase, spaces, excluded in priors:
        hit = F.size(F.array_except(type_tokens(F.lit(phrase)), words)) == 0
        if excluded:
            hit &= ~F.arrays_overlap(words, F.array(*(F.lit(x.lower()) for x in excluded)))
        parts.append(F.when(hit, F.array(*(F.lit(s.lower()) for s in spaces))).otherwise(F.array().cast("array<string>")))
    return F.when(property_type.isNull() | (F.trim(property_type) == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(*parts)))


def with_spaces(df: DataFrame, priors: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """Add the namespaces that each row's property type asks for (_spaces): one evaluation per property type, not per row."""
    types = df.select(F.col("property_type").alias("_type")).filter("_type is not null").distinct().withColumn("_spaces", preferred_namespaces(F.col("_type"), priors))
    return df.join(types, F.col("property_type") == F.col("_type"), "left").drop("_type")


def type_prior(df: DataFrame, priors: list[tuple[str, list[str], list[str]]], near: bool = False) -> DataFrame:
    """Where a whole match lies in a namespace that the property type prefers, raise such matches and lower all rows outside. Rows may have their _spaces already."""
    if not priors:
        return df
    inside = F.arrays_overlap(ids.memberships(F.col("ontology"), F.col("term_id")), F.col("_spaces"))
    e = (df if "_spaces" in df.columns else with_spaces(df, priors)).withColumn("_in", F.coalesce(inside, F.lit(False)))
    e = with_stats(e, ["prop_id"], near=near, _grounded=F.bool_or(F.col("_in") & ev.is_full(F.col("tier"))))
    moved = (
        F.when(~F.col("_grounded"), F.col("confidence"))
        .when(F.col("_in") & ev.is_full(F.col("tier")), F.least(F.lit(1.0), F.col("confidence") + PRIOR))
        .when(~F.col("_in"), F.greatest(F.lit(0.0), F.col("confidence") - PRIOR))
        .otherwise(F.col("confidence"))
    )
    return e.withColumn("confidence", moved).drop("_spaces", "_in", "_grounded")


def _order() -> Column:
    """The ranking as a struct whose smallest value is the best row."""
    return F.struct((-F.col("confidence")).alias("c"), F.when(F.coalesce("preferred", F.lit(False)), 0).otherwise(1).alias("p"), F.col("rank").alias("r"), F.col("seq").alias("s"))


def _with_preferred(df: DataFrame) -> DataFrame:
    return df if "preferred" in df.columns else df.withColumn("preferred", F.lit(None).cast("boolean"))


def chain_of(df: DataFrame) -> Column:
    """A row's steps of provenance: its own, or the one step that its columns tell."""
    if "chain" in df.columns:
        return F.col("chain")
    text = F.col("text") if "text" in df.columns else F.lit(None)
    return F.array(ev.step(F.col("method"), F.col("kind"), F.col("datasource"), None, None, text, F.col("label"), F.col("confidence"), F.col("iri")))


def corroborate_near(df: DataFrame) -> DataFrame:
    """corroborate by windows over a property's terms, for properties of few rows: rows that lie by property are not moved again."""
    e = _with_preferred(df).withColumn("_channel", F.concat_ws(":", "method", "kind"))
    counted = F.when((F.col("confidence") >= LEAST_SUPPORT) & F.col("kind").isNotNull(), F.col("seq"))
    one, term = Window.partitionBy("prop_id", "term_key", "_channel"), Window.partitionBy("prop_id", "term_key")
    e = e.select("*", F.min(counted).over(one).alias("_first"), F.min_by(chain_of(e), counted).over(one).alias("_c"))
    # Of a channel all rows tell the same, so that the set has each channel once.
    found = F.collect_set(F.when(F.col("_first").isNotNull(), F.struct(F.col("_first").alias("first"), "_channel", F.col("_c").alias("c"))))
    e = e.select("*", F.min(F.struct(_order().alias("o"), "_channel")).over(term).alias("_best"), found.over(term).alias("_found"))
    others = F.filter("_found", lambda x: x["_channel"] != F.col("_best._channel"))
    best = F.col("term_key").isNotNull() & F.coalesce(F.col("seq") == F.col("_best.o.s"), F.lit(False))
    e = e.withColumn("_support", F.when(best & (F.size(others) > 0), F.transform(F.array_sort(others), lambda x: x["c"])))
    return _raised(e).drop("_support", "_channel", "_first", "_c", "_best", "_found")


def _raised(e: DataFrame) -> DataFrame:
    """Rows with _support, which is null unless it raises them."""
    top = F.when(F.col("tier") == "NONE", F.col("confidence")).otherwise(F.greatest(ev.ceiling(F.col("tier")), F.col("confidence")))
    raised = F.least(top, F.col("confidence") + F.size("_support") * BONUS)
    return e.withColumn("supporting", F.col("_support")).withColumn("confidence", F.when(F.col("_support").isNotNull(), raised).otherwise(F.col("confidence")))


def corroborate(df: DataFrame) -> DataFrame:
    """Raise the best row of a term by BONUS for every other channel that found it with LEAST_SUPPORT or more, up to its class's ceiling.

    ``supporting`` of that row gets the chain of the first such row of each channel, in order of place. A channel is a method and kind of match;
    their number bounds what is collected per term, as rows are first combined per channel.
    """
    e = _with_preferred(df).withColumn("_channel", F.concat_ws(":", "method", "kind"))
    counts = (F.col("confidence") >= LEAST_SUPPORT) & F.col("kind").isNotNull()
    per_channel = e.filter("term_key is not null").groupBy("prop_id", "term_key", "_channel").agg(
        F.min(_order()).alias("o"), F.min(F.when(counts, F.col("seq"))).alias("first"), F.min_by(chain_of(e), F.when(counts, F.col("seq"))).alias("c")
    )
    found = F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "_channel", "c")))
    per_term = per_channel.groupBy("prop_id", "term_key").agg(F.min(F.struct("o", "_channel")).alias("_best"), found.alias("_found"))
    others = F.filter("_found", lambda x: x["_channel"] != F.col("_best._channel"))
    # Only rows that are raised come with what supports them; other terms need no join partner.
    per_term = per_term.select(F.col("prop_id").alias("_p"), F.col("term_key").alias("_k"), F.col("_best.o.s").alias("_seq"), F.transform(F.array_sort(others), lambda x: x["c"]).alias("_support")).filter("size(_support) > 0")
    e = e.join(per_term, (F.col("prop_id") == F.col("_p")) & (F.col("term_key") == F.col("_k")) & (F.col("seq") == F.col("_seq")), "left")
    return _raised(e).drop("_p", "_k", "_seq", "_support", "_channel")


def _semantic() -> Column:
    return F.coalesce(F.col("method") == "semantic", F.lit(False))


def suppress_embedding(df: DataFrame) -> DataFrame:
    """A curated whole match silences the embedding rows of its property."""
    e = with_stats(df, ["prop_id"], _exact=F.bool_or(F.col("tier") == "CURATED_FULL"))
    return e.filter(~(F.col("_exact") & _semantic())).drop("_exact")


def best_embedding(df: DataFrame) -> DataFrame:
    """Of the embedding rows keep those within EMBEDDING_GAP of the best."""
    e = with_stats(df, ["prop_id"], _top=F.max(F.when(_semantic(), F.col("confidence"))))
    weak = _semantic() & (F.col("_top") > 0) & (F.col("confidence") < F.col("_top") - EMBEDDING_GAP)
    return e.filter(~F.coalesce(weak, F.lit(False))).drop("_top")


def prune_weak(df: DataFrame, f: Filter) -> DataFrame:
    """Drop rows far below the best; with targets, a tight gap inside each target (hard) or against rows outside them (soft). Maxima are taken before any row goes."""
    targets = f.low_targets
    e = df.withColumn("_t", ids.target_of(F.col("ontology"), F.col("term_id"), targets))
    tops = {f"_b{i}": F.max(F.when(F.col("_t") == t, F.col("confidence"))) for i, t in enumerate(targets)}
    e = with_stats(e, ["prop_id"], _best=F.greatest(F.lit(0.0), F.max("confidence")), **tops)
    return e.filter(~_is_weak(f)).drop("_t", "_best", *tops)


def _is_weak(f: Filter) -> Column:
    """Whether prune_weak drops a row, given its target _t, the best score _best of its property and _b0, _b1, ... of each target in it."""
    targets, conf = f.low_targets, F.col("confidence")
    tops = [f"_b{i}" for i in range(len(targets))]
    own = F.coalesce(*(F.when(F.col("_t") == t, F.col(f"_b{i}")) for i, t in enumerate(targets)), F.lit(None).cast("double"))
    low = (F.col("_best") >= WEAK_BEST) & (conf < F.col("_best") - WEAK_GAP)
    if f.hard:
        drop = (low & ~F.coalesce(conf >= own, F.lit(False))) | F.coalesce(conf < own - TARGET_GAP, F.lit(False))
    elif targets:
        best_target = F.greatest(*(F.col(t) for t in tops), F.lit(None).cast("double"))
        drop = low | (F.col("_t").isNull() & F.coalesce(best_target >= conf - TARGET_GAP, F.lit(False)))
    else:
        drop = low
    return drop


def prune(df: DataFrame, f: Filter, hot: DataFrame | None = None, near: bool = False) -> DataFrame:
    """suppress_embedding, best_embedding and prune_weak with one aggregation.

    What the vector rows leave of a maximum follows from the maxima of vector rows and of other rows: a target's best vector row stays if
    any of its vector rows does.
    """
    targets, vector, conf = f.low_targets, _semantic(), F.col("confidence")
    e = df.withColumn("_t", ids.target_of(F.col("ontology"), F.col("term_id"), targets))
    of = lambda i, which: F.max(F.when((F.col("_t") == targets[i]) & which, conf))
    each = {f"_{side}{i}": of(i, which) for i in range(len(targets)) for side, which in (("v", vector), ("w", ~vector))}
    e = with_stats(e, ["prop_id"], hot, near, _exact=F.bool_or(F.col("tier") == "CURATED_FULL"), _top=F.max(F.when(vector, conf)), _rest=F.max(F.when(~vector, conf)), **each)
    stays = lambda score: F.coalesce(~F.col("_exact") & ((F.col("_top") <= 0) | (score >= F.col("_top") - EMBEDDING_GAP)), F.lit(False))
    e = e.filter(~vector | stays(conf))
    kept = lambda score: F.when(stays(score), score)
    e = e.withColumn("_best", F.greatest(F.lit(0.0), F.col("_rest"), kept(F.col("_top"))))
    for i in range(len(targets)):
        e = e.withColumn(f"_b{i}", F.greatest(F.col(f"_w{i}"), kept(F.col(f"_v{i}"))))
    return e.filter(~_is_weak(f)).drop("_t", "_best", "_exact", "_top", "_rest", *each, *(f"_b{i}" for i in range(len(targets))))


def one_per_term(df: DataFrame) -> DataFrame:
    """The best row of each term, at the place (pos) of the term's first row. Rows without a term key are dropped."""
    e = _with_preferred(df).filter("term_key is not null")
    best = e.groupBy("prop_id", "term_key").agg(F.min_by(F.struct(*e.columns), _order()).alias("b"), F.min("seq").alias("pos"))
    # The key itself, not its copy in the struct: rows still lie by it.
    return best.select(*(F.col("prop_id") if c == "prop_id" else F.col("b")[c].alias(c) for c in e.columns), "pos")


def best_per_target(df: DataFrame, f: Filter) -> DataFrame:
    """Of each target ontology's rows keep the best, ties included; other rows stay."""
    if not f.targets:
        return df
    e = df.withColumn("_t", ids.target_of(F.col("ontology"), F.col("term_id"), f.low_targets))
    e = with_stats(e, ["prop_id", "_t"], _top=F.max("confidence"))
    return e.filter(F.col("_t").isNull() | (F.col("confidence") >= F.col("_top"))).drop("_t", "_top")


def _is_beaten(targets: list[str]) -> Column:
    """Whether an earlier target of the property has a row at least as good, given _t and _b0, _b1, ..."""
    place = {t: i for i, t in enumerate(targets)}  # of a name given twice the last place counts
    beaten = F.lit(False)
    for t, i in place.items():
        before = [F.coalesce(F.col(f"_b{j}") >= F.col("confidence"), F.lit(False)) for u, j in place.items() if j < i]
        if before:
            beaten = F.when(F.col("_t") == t, reduce(lambda a, b: a | b, before)).otherwise(beaten)
    return beaten


def higher_priority_on_tie(df: DataFrame, f: Filter) -> DataFrame:
    """Drop a target's row if an earlier target has one at least as good. Per property one maximum for each target."""
    targets = f.low_targets
    if len(targets) < 2:
        return df
    e = df.withColumn("_t", ids.target_of(F.col("ontology"), F.col("term_id"), targets))
    e = with_stats(e, ["prop_id"], **{f"_b{i}": F.max(F.when(F.col("_t") == t, F.col("confidence"))) for i, t in enumerate(targets)})
    return e.filter(~_is_beaten(targets)).drop("_t", *(f"_b{i}" for i in range(len(targets))))


def target_rules(terms: DataFrame, f: Filter) -> DataFrame:
    """best_per_target and higher_priority_on_tie on rows reduced to terms, with the same maxima for both: a window over a property's terms, of which there are no more than the vocabulary has."""
    targets = f.low_targets
    if not targets:
        return terms
    e = terms.withColumn("_t", ids.target_of(F.col("ontology"), F.col("term_id"), targets))
    w = Window.partitionBy("prop_id")
    tops = {f"_b{i}": F.max(F.when(F.col("_t") == t, F.col("confidence"))).over(w) for i, t in enumerate(targets)}
    e = e.select("*", *(c.alias(n) for n, c in tops.items()))
    own = F.coalesce(*(F.when(F.col("_t") == t, F.col(f"_b{i}")) for i, t in enumerate(targets)), F.lit(None).cast("double"))
    return e.filter((F.col("_t").isNull() | (F.col("confidence") >= own)) & ~_is_beaten(targets)).drop("_t", *tops)


def mark_preferred(df: DataFrame, preferred: tuple[str, ...]) -> DataFrame:
    """Flag rows from a preferred source or ontology; a tie-breaker, not a score."""
    if not preferred:
        return _with_preferred(df)
    low = [p.lower() for p in preferred]
    hit = F.coalesce(F.lower("datasource").isin(low), F.lit(False)) | F.arrays_overlap(ids.memberships(F.col("ontology"), F.col("term_id")), F.array(*map(F.lit, low)))
    return _with_preferred(df).withColumn("preferred", F.when(F.coalesce(hit, F.lit(False)), True).otherwise(F.col("preferred")))


def _prepared(df: DataFrame, f: Filter, excluded: list[str], priors: list, near: bool = False) -> DataFrame:
    """Filtered, classified and adjusted rows, written once: what follows aggregates and joins back, which reads its input several times. Windows read it once."""
    e = classify(defining_only(hard_ontologies(required_sources(exclude_terms(df, excluded), f.required), f), f))
    # By property at once: else each window would move the rows by its own, finer key.
    return type_prior(e.repartition("prop_id"), priors, True) if near else cut_lineage(type_prior(e, priors))


def reduce_full(df: DataFrame, f: Filter = Filter(), excluded: list[str] = [], priors: list = [], near: bool = False) -> DataFrame:  # noqa: B006
    """All rules in order: exclusion, sources, ontologies, namespaces, type prior, corroboration, embedding rules, pruning, one per term, targets, preference.

    ``near``: no property has more than a few rows per term of the vocabulary, so that windows do in one pass over rows moved once what else takes joins.
    """
    e = _prepared(df, f, excluded, priors, near)
    kept = prune(corroborate_near(e), f, None, True) if near else prune(corroborate(e), f, hot_properties(e))
    return mark_preferred(target_rules(one_per_term(kept), f), f.preferred)


def reduce_light(df: DataFrame, f: Filter = Filter(), excluded: list[str] = [], priors: list = [], near: bool = False) -> DataFrame:  # noqa: B006
    """For callers that want all results: no suppression, pruning or target rules."""
    return mark_preferred(one_per_term((corroborate_near if near else corroborate)(_prepared(df, f, excluded, priors, near))), f.preferred)


def ranking(place: str = "pos") -> list[Column]:
    """Sort keys of results: confidence, preferred first, stronger evidence, then place."""
    return [F.coalesce(F.col("confidence"), F.lit(0.0)).desc(), F.when(F.coalesce("preferred", F.lit(False)), 0).otherwise(1).asc(), F.col("rank").asc(), F.col(place).asc()]


def settled_properties(df: DataFrame, f: Filter, excluded: list[str] = []) -> DataFrame:  # noqa: B006
    """prop_id of the properties with a row that settles them: from a target, with WEAK_BEST or more, of its own namespace if only such terms count, and not excluded."""
    term = F.col("term_id")
    settles = ids.target_of(F.col("ontology"), term, f.low_targets).isNotNull() & (F.col("confidence") >= WEAK_BEST)
    if f.defining_only:
        settles &= ids.in_namespaces(term, f.low_targets)
    return exclude_terms(df, excluded).filter(F.coalesce(settles, F.lit(False))).select("prop_id").distinct()


def needs_deep(df: DataFrame, f: Filter, deep: bool | None = None, excluded: list[str] = []) -> DataFrame:  # noqa: B006
    """prop_id of the properties whose shallow evidence settles nothing. An explicit ``deep`` decides; without targets nothing is escalated."""
    props = df.select("prop_id").distinct()
    if deep is not None:
        return props if deep else props.limit(0)
    if not f.targets:
        return props.limit(0)
    return props.join(settled_properties(df, f, excluded), "prop_id", "left_anti")
