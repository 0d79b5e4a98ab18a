"""The mapper on a small vocabulary: what is searched, how it is scored, and what each request sees."""

import pytest

from termweave.functions.evidence import STEP
from termweave.operators import search
from termweave.plans import service
from termweave.plans.filters import Filter

TERMS = [
    ("http://t/DIZO_1", "DIZO_1", "myocardial infarction", "dizo", False, None, ["cardiac infarct"]),
    ("http://t/DIZO_2", "DIZO_2", "melanoma", "dizo", False, None, []),
    ("http://t/TAXIX_1", "TAXIX_1", "rat", "taxix", False, None, []),
    ("http://t/TAXIX_2", "TAXIX_2", "rat strain", "taxix", False, None, []),
    ("http://t/EXPIX_1", "EXPIX_1", "exposure to cadmium", "expix", False, None, []),
    ("http://t/CHEMIX_1", "CHEMIX_1", "cadmium atom", "expix", False, None, ["cadmium"]),
    ("http://t/DIZO_9", "DIZO_9", "obsolete old thing", "dizo", True, "http://t/DIZO_2", []),
]
PROPS = "prop_id long, property_type string, text string"


@pytest.fixture(scope="module")
def vocabulary(spark):
    terms = spark.createDataFrame(TERMS, "iri string, short_form string, label string, ontology string, obsolete boolean, replaced_by string, synonyms array<string>")
    curated = spark.createDataFrame([("blue rat", "TAXIX_1", "atlas")], "text string, term_id string, datasource string")
    xrefs = spark.createDataFrame([("http://t/TAXIX_1", "XR:7", "XR:7", "seven", 1)], "source_iri string, target_id string, target_iri string, target_label string, distance int")
    return service.Vocabulary(terms, curated, xrefs)


def found(spark, v, *texts, **how):
    props = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], PROPS)
    out = {t: {} for t in texts}
    for r in service.map_properties(props, v, **how).collect():
        out[texts[r.prop_id]][r.term_id] = (r.kind, round(r.confidence, 4))
    return out


def test_classes_of_what_is_found(spark, vocabulary):
    """A synonym is no label, a misspelt word is found, a definitive answer ends the search."""
    got = found(spark, vocabulary, "Cardiac Infarct", "melanomma", "rat")
    assert got["Cardiac Infarct"] == {"DIZO_1": ("OLS_TEXT_TAGGER_SYNONYM", 0.9)}
    assert got["melanomma"]["DIZO_2"] == ("OLS_LEXICAL_FUZZY", round(0.7 * (1 - 1 / 9), 4))
    assert set(got["rat"]) == {"TAXIX_1"}
    lexical = search.lexical(spark.createDataFrame([("cardiac infarct",)], "text string"), vocabulary.terms).collect()
    assert [(r.kind, r.confidence) for r in lexical] == [("OLS_LEXICAL_FUZZY_SYNONYM", 0.9)]


def test_an_excluded_answer_reopens_the_search(spark, vocabulary):
    assert set(found(spark, vocabulary, "rat", excluded=["taxix_1"])["rat"]) == {"TAXIX_2"}


def test_all_results_are_searched_for(spark, vocabulary):
    assert set(found(spark, vocabulary, "rat", return_all=True)["rat"]) == {"TAXIX_1", "TAXIX_2"}


def test_own_terms_are_not_demoted_by_imported_ones(spark, vocabulary):
    texts = spark.createDataFrame([("cadmium",)], "text string")
    score = lambda f: {r.term_id: round(r.confidence, 4) for r in search.lexical(texts, vocabulary.terms, f).collect()}
    own = Filter(targets=("expix",), include_other=False, defining_only=True)
    assert score(own)["EXPIX_1"] == 0.89 and score(Filter(targets=("expix",)))["EXPIX_1"] == round(0.89 * 0.75, 4)


def test_curated_parts_sources_and_chains(spark, vocabulary):
    e = service.evidence_of(spark.createDataFrame([("a blue rat",), ("obsolete old thing",)], "text string"), vocabulary).collect()
    curated = [r for r in e if r.kind.startswith("CURATED")]
    assert [(r.kind, r.datasource, r.term_id) for r in curated] == [("CURATED_SUBSTRING", "atlas", "TAXIX_1")]
    moved = next(r for r in e if r.text == "obsolete old thing" and r.kind == "OLS_TEXT_TAGGER")
    assert moved.term_id == "DIZO_2" and [s.matchType for s in moved.chain] == ["OLS_TEXT_TAGGER", "OBSOLETE_REPLACEMENT"]
    assert moved.chain[1].matchedText == "obsolete old thing → melanoma"


def test_cross_references_of_unknown_targets(spark, vocabulary):
    e = service.evidence_of(spark.createDataFrame([("rats strain",)], "text string"), vocabulary, Filter(targets=("xr",))).collect()
    far = [r for r in e if r.seq.startswith("04")]
    assert {(r.term_id, r.label, r.datasource, r.chain[-1].matchedText) for r in far} <= {("XR:7", "rats strain", "xr", "rat ≈ seven (distance=1)")}
    seeds = spark.createDataFrame([("t", "01|x", "http://t/TAXIX_1", "TAXIX_1", "rat", "taxix", "OLS_LEXICAL_FUZZY", 0.8, "taxix", None)], f"text string, seq string, iri string, term_id string, label string, ontology string, kind string, confidence double, datasource string, chain array<{STEP}>")
    row = service.xref_evidence(seeds, vocabulary, Filter(targets=("xr",))).first()
    assert (row.term_id, row.label, row.ontology, row.datasource, round(row.confidence, 4)) == ("XR:7", "t", None, "xr", 0.76)
    assert service.xref_evidence(seeds, vocabulary, Filter(targets=("xr", "taxix"))).count() == 0


def test_vectors_merge_scope_and_deepen(spark):
    unit = lambda *x: [float(a) for a in x] + [0.0] * (64 - len(x))
    asked = spark.createDataFrame([(1, "Aa", unit(1, 0)), (2, "aa", unit(0.9, 0.4358899))], "id long, text string, vector array<float>")
    known = spark.createDataFrame([(10, "i1", "dizo", unit(1, 0.1)), (11, "i2", "phexo", unit(0.8, 0.6)), (12, "i3", "dizo", unit(0, 1)), (13, "i1", "dizo", unit(0.9, 0.43))], "id long, iri string, ontology string, vector array<float>")
    texts = spark.createDataFrame([("Aa",)], "text string")
    hits = lambda f, k: {r.iri: round(r.score, 3) for r in search.by_vectors(texts, asked, known, f, k).collect()}
    assert hits(Filter(), 10) == {"i1": 1.0, "i2": 0.982}  # i3 is under the cut; small letters are asked too
    assert hits(Filter(targets=("phexo",), include_other=False), 1) == {"i2": 0.982}
    assert hits(Filter(targets=tuple("abcdef"), include_other=False), 1) == {"i1": 1.0}  # too many targets: over all
    shallow = search.by_vectors(texts, asked, known, k=1)
    assert {r.iri for r in search.unseen(search.by_vectors(texts, asked, known, k=9), shallow).collect()} == {"i2"}


def test_near_terms_only_where_no_target_answers(spark, vocabulary):
    unit = lambda *x: [float(a) for a in x] + [0.0] * (64 - len(x))
    vectors = spark.createDataFrame([(1, "http://t/TAXIX_1", "taxix", unit(1, 0)), (2, "http://t/DIZO_2", "dizo", unit(0.9, 0.2)), (3, "http://t/EXPIX_1", "expix", unit(1, 0.01))], "id long, iri string, ontology string, vector array<float>")
    v = service.Vocabulary(vocabulary.terms, vocabulary.curated, vocabulary.xrefs, None, vectors, "m")
    seeds = spark.createDataFrame([("t", "01|x", "http://t/TAXIX_1", "TAXIX_1", "rat", "taxix", "OLS_LEXICAL_FUZZY", 0.8, "taxix", None), ("u", "01|x", "http://t/TAXIX_1", "TAXIX_1", "rat", "taxix", "OLS_EMBEDDING", 0.8, "taxix", None)], f"text string, seq string, iri string, term_id string, label string, ontology string, kind string, confidence double, datasource string, chain array<{STEP}>")
    rows = service.near_evidence(seeds, v, Filter(targets=("dizo",))).collect()
    assert [(r.text, r.term_id, round(r.confidence, 3), [s.matchType for s in r.chain]) for r in rows] == [("t", "DIZO_2", round(0.8 * 0.7 * 0.976187, 3), ["OLS_LLM_SIMILAR"])]
    assert service.near_evidence(seeds, v, Filter(targets=("taxix", "dizo"))).count() == 0


def test_segments_of_one_spelling_ask_once(spark, vocabulary):
    docs = spark.createDataFrame([(1, "Melanoma was seen. It was melanoma."), (2, None)], "d long, t string")
    parts, results = service.annotate_text(docs, "d", "t", vocabulary)
    assert {(r.text, r.prop_id) for r in parts.collect() if r.text.lower() == "melanoma"} == {("Melanoma", "Melanoma"), ("melanoma", "Melanoma")}
    assert [r.term_id for r in results.filter("prop_id = 'Melanoma'").collect()] == ["DIZO_2"]
