import random

import pytest
from pyspark.sql import functions as F

from termweave.operators import rules
from termweave.plans.filters import Filter, RequestError, check_request, check_text, parse_filter

SCHEMA = "prop_id string, seq long, term_id string, iri string, label string, ontology string, confidence double, kind string, datasource string, property_type string"
HARD = Filter(targets=("efo", "mondo"), include_other=False)


def ev(spark, *items, prop="p"):
    """Items are (term_id, confidence, kind, ontology, datasource, type), the last four optional."""
    rows = []
    for i, it in enumerate(items):
        t, c, *rest = it
        kind, onto, ds, ty = (*rest, *[None] * (4 - len(rest)))
        rows.append((prop, i, t, f"http://x/{t}" if t else None, t, onto or (t or "x_").split("_")[0].lower(), float(c), kind or "OLS_TEXT_TAGGER_SUBSTRING", ds, ty))
    return spark.createDataFrame(rows, SCHEMA)


def ids_of(df, place="seq"):
    return [r.term_id for r in df.orderBy(place).collect()]


@pytest.mark.parametrize(
    "f, items, want",
    [
        (Filter(), [("FOODON_1", 1.0), ("EFO_1", 0.85), ("MONDO_1", 0.79)], ["FOODON_1", "EFO_1"]),
        (Filter(), [("EFO_1", 0.65), ("EFO_2", 0.3)], ["EFO_1", "EFO_2"]),
        (Filter(targets=("efo",)), [("EFO_1", 1.0), ("FOODON_1", 0.97), ("MONDO_1", 0.9)], ["EFO_1"]),
        (HARD, [("EFO_1", 1.0), ("EFO_2", 0.97), ("EFO_3", 0.9), ("MONDO_1", 0.6), ("MONDO_2", 0.5)], ["EFO_1", "EFO_2", "MONDO_1"]),
    ],
)
def test_weak_results(spark, f, items, want):
    assert ids_of(rules.prune_weak(rules.classify(ev(spark, *items)), f)) == want


def test_end_to_end_priority(spark):
    items = [("EFO_1", 1.0), ("EFO_2", 0.9), ("MONDO_1", 0.6), ("MONDO_2", 0.58)]
    assert ids_of(rules.reduce_full(ev(spark, *items), Filter(targets=("mondo", "efo"), include_other=False)), "pos") == ["EFO_1", "MONDO_1"]
    assert ids_of(rules.reduce_full(ev(spark, *items), HARD), "pos") == ["EFO_1"]


def test_one_per_term_keeps_the_first_place(spark):
    out = rules.one_per_term(rules.classify(ev(spark, ("A_1", 0.5), ("B_1", 0.6), ("A_1", 0.8), (None, 0.9)))).orderBy("pos").collect()
    assert [(r.term_id, r.confidence, r.seq, r.pos) for r in out] == [("A_1", 0.8, 2, 0), ("B_1", 0.6, 1, 1)]


def test_full_tie_keeps_the_earlier_row(spark):
    out = rules.one_per_term(rules.classify(ev(spark, ("A_1", 0.8), ("A_1", 0.8)))).collect()
    assert [r.seq for r in out] == [0]


@pytest.mark.parametrize(
    "items, want, support",
    [
        ([("A_1", 0.8, "OLS_TEXT_TAGGER_SUBSTRING"), ("A_1", 0.6, "OLS_EMBEDDING")], 0.82, 1),
        ([("A_1", 0.88, "OLS_TEXT_TAGGER_SUBSTRING"), ("A_1", 0.6, "OLS_EMBEDDING")], 0.89, 1),
        ([("A_1", 0.8, "OLS_TEXT_TAGGER_SUBSTRING"), ("A_1", 0.49, "OLS_EMBEDDING")], 0.8, 0),
        ([("A_1", 0.8, "OLS_TEXT_TAGGER_SUBSTRING"), ("A_1", 0.7, "OLS_TEXT_TAGGER_SUBSTRING")], 0.8, 0),
        ([("A_1", 0.8, "OLS_TEXT_TAGGER_SUBSTRING"), ("A_1", 0.7, "OLS_EMBEDDING"), ("A_1", 0.6, "OLS_LEXICAL_FUZZY")], 0.84, 2),
    ],
)
def test_corroboration(spark, items, want, support):
    top = rules.corroborate(rules.classify(ev(spark, *items))).orderBy("seq").first()
    assert top.confidence == pytest.approx(want) and len(top.supporting or []) == support


PRIORS = [("organism", ["taxa"], ["part"]), ("cell type", ["cl"], [])]


@pytest.mark.parametrize("kind, ptype, want", [("OLS_TEXT_TAGGER", "organism", [1.0, 0.9]), ("OLS_EMBEDDING", "organism", [0.95, 1.0]), ("OLS_TEXT_TAGGER", "organism part", [0.95, 1.0]), ("OLS_TEXT_TAGGER", None, [0.95, 1.0]), ("OLS_TEXT_TAGGER", "organismPart", [0.95, 1.0])])
def test_type_prior(spark, kind, ptype, want):
    e = ev(spark, ("TAXA_1", 0.95, kind, None, None, ptype), ("FOODON_1", 1.0, "OLS_TEXT_TAGGER", None, None, ptype))
    got = [r.confidence for r in rules.type_prior(rules.classify(e), PRIORS).orderBy("seq").collect()]
    assert got == pytest.approx(want)


def mixed(spark, n=600):
    r = random.Random(3)
    rows = []
    for i in range(n):
        t, kind = f"{r.choice(['EFO', 'MONDO', 'HP'])}_{r.randint(1, 9)}", r.choice(["CURATED_EXACT", *["OLS_EMBEDDING"] * 6, *["OLS_LEXICAL_FUZZY"] * 6])
        rows.append((r.choice(["hot", "hot", *"abcdefghij"]), i, t, f"http://x/{t}", t, r.choice(["efo", "hp", "mondo"]), r.choice([0.0, 0.3, 0.55, 0.69, 0.7, 0.846, 0.85, 0.95, 1.0]), kind, None, None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("f", [Filter(), HARD, Filter(targets=("mondo", "efo"))])
def test_joint_rules_equal_the_single_ones(spark, f, monkeypatch):
    e = rules.classify(mixed(spark))
    single = rules.prune_weak(rules.best_embedding(rules.suppress_embedding(e)), f)
    want = sorted(r.seq for r in single.collect())
    assert sorted(r.seq for r in rules.prune(e, f).collect()) == want
    monkeypatch.setattr(rules, "HOT_ROWS", 30)
    hot = rules.hot_properties(e)
    assert {r.prop_id for r in hot.collect()} >= {"hot"}
    assert sorted(r.seq for r in rules.prune(e, f, hot).collect()) == want
    one = rules.one_per_term(single)
    assert sorted(r.seq for r in rules.target_rules(one, f).collect()) == sorted(r.seq for r in rules.higher_priority_on_tie(rules.best_per_target(one, f), f).collect())


def test_filters(spark):
    e = ev(spark, ("EFO_1", 0.9, "CURATED_EXACT", "efo", "Atlas"), ("EFO_2", 0.9, "CURATED_SUBSTRING", "efo", None), ("HP_1", 0.9, "OLS_TEXT_TAGGER", "efo", "efo"), ("77", 0.9, "OLS_TEXT_TAGGER", "mondo", "x"))
    assert ids_of(rules.required_sources(e, ("atlas",))) == ["EFO_1", "HP_1", "77"]
    assert ids_of(rules.defining_only(e, Filter(targets=("efo", "mondo"), defining_only=True))) == ["EFO_1", "EFO_2", "77"]
    assert ids_of(rules.defining_only(e, Filter(defining_only=True))) == ["EFO_1", "EFO_2", "HP_1", "77"]
    assert ids_of(rules.hard_ontologies(e, Filter(targets=("hp",), include_other=False))) == ["HP_1"]
    assert ids_of(rules.exclude_terms(e, ["http://x/EFO_1", "hp_1", None, " "])) == ["EFO_2", "77"]


@pytest.mark.parametrize(
    "items, f, deep, want",
    [
        ([("EFO_1", 0.7)], HARD, None, 0),
        ([("EFO_1", 0.69)], HARD, None, 1),
        ([("HP_1", 0.9, None, "efo")], Filter(targets=("efo",), defining_only=True), None, 1),
        ([("HP_1", 0.1)], Filter(), None, 0),
        ([("EFO_1", 0.9)], HARD, True, 1),
        ([("EFO_1", 0.1)], HARD, False, 0),
    ],
)
def test_escalation(spark, items, f, deep, want):
    assert rules.needs_deep(ev(spark, *items), f, deep).count() == want


def test_empty_evidence(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert rules.reduce_full(e, HARD, ["X_1"], PRIORS).count() == rules.reduce_light(e).count() == 0


def test_hot_property_is_whole(spark):
    e = spark.range(3000).select(F.lit("hot").alias("prop_id"), F.col("id").alias("seq"), F.concat(F.lit("EFO_"), F.col("id") % 1000).alias("term_id"), F.lit(None).cast("string").alias("iri"), F.lit("l").alias("label"), F.lit("efo").alias("ontology"), F.lit(0.9).alias("confidence"), F.lit("OLS_TEXT_TAGGER_SUBSTRING").alias("kind"), F.lit(None).cast("string").alias("datasource"), F.lit(None).cast("string").alias("property_type"))
    assert rules.one_per_term(rules.classify(e)).count() == 1000


def test_parse_filter():
    f = parse_filter("required:[a, b],preferred:[c],ontologies:[EFO,mondo],defining_only:[TRUE]")
    assert f == Filter(("a", "b"), ("c",), ("EFO", "mondo"), False, True)
    assert parse_filter("ontologies:[none]") == Filter()
    assert parse_filter("required:[none]").required == ("none",)
    assert parse_filter(None) == parse_filter(" ") == Filter()
    for bad in ("what:[a]", "required=a", "defining_only:[maybe]"):
        with pytest.raises(RequestError):
            parse_filter(bad)


def test_limits():
    check_request([(None, "x")])
    check_text("x")
    for bad in ([], [(None, " ")], [(None, "x")] * 1001):
        with pytest.raises(RequestError):
            check_request(bad)
    with pytest.raises(RequestError):
        check_request([(None, "x")] * 201, deep=True)
    with pytest.raises(RequestError):
        check_text("x" * 50_001)
