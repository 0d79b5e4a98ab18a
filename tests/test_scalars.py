import pytest
from pyspark.sql import functions as F

from termweave.functions import evidence as ev
from termweave.functions import ids
from termweave.functions import similarity as sim
from termweave.functions.variants import variants


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("a, b, want", [("melanoma", "melanoma", 1.0), ("breast cancer", "cancer of breast", 2 / 3), ("", "", 1.0), ("", "x", 0.0), (None, "x", 0.0)])
def test_jaccard(spark, a, b, want):
    assert one(spark, sim.jaccard(sim.tokens(F.lit(a).cast("string")), sim.tokens(F.lit(b)))) == pytest.approx(want)


@pytest.mark.parametrize("a, b, want", [("kitten", "sitting", 1 - 3 / 7), ("tumör", "tumor", 0.8), (" A  b ", "a b", 1.0), ("", "a", 0.0), (None, None, 1.0)])
def test_edit_similarity(spark, a, b, want):
    assert one(spark, sim.edit_similarity(F.lit(a).cast("string"), F.lit(b).cast("string"))) == pytest.approx(want)


@pytest.mark.parametrize("q, c, want", [("cadmium", "cadmium", 1.0), ("cadmium", "exposure to cadmium", 0.75), ("cadmium", "lead", 0.0), ("the", "the cat", 0.0)])
def test_containment(spark, q, c, want):
    assert one(spark, sim.containment(F.lit(q), F.lit(c))) == pytest.approx(want)


def test_tightest_containment_scores(spark):
    got = [one(spark, ev.tier_confidence(F.lit("PARTIAL"), sim.containment_score(F.lit(2), F.lit(n)))) for n in (2, 3, 4)]
    assert got == pytest.approx([0.89, 0.89 * 5 / 6, 0.89 * 0.75])


@pytest.mark.parametrize(
    "text, want",
    [
        ("tumours", ["tumour", "tumors"]),
        ("mice", ["mouse"]),
        ("Mice", ["Mouse"]),
        ("IL-6", ["IL 6", "IL6"]),
        ("IL6", ["IL-6"]),
        ("Type II diabetes", ["Type 2 diabetes"]),
        ("diabetes", []),
        ("wild type", ["wild-type", "wild types"]),
        ("E. coli", []),
        ("analyze", ["analyzes"]),
        ("grade 3 glioma", ["grade III glioma"]),
        ("beta cell", ["beta-cell", "beta cells", "β cell"]),
        ("  ", []),
        (None, []),
    ],
)
def test_variants(spark, text, want):
    assert list(one(spark, variants(F.lit(text).cast("string")))) == [w for w in want]


@pytest.mark.parametrize("x, want", [("EFO_0000400", "efo"), ("EFO:0000400", "efo"), ("http://a.b/EDAM_data_0006", "edam"), ("http://a.b/x#HP_1", "hp"), ("123", None), ("_1", None), ("http://a.b/", None), ("", None), (None, None)])
def test_prefix(spark, x, want):
    assert one(spark, ids.prefix_of(F.lit(x).cast("string"))) == want


def test_target_prefers_the_namespace_of_the_id(spark):
    assert one(spark, ids.target_of(F.lit("EFO"), F.lit("MONDO_1"), ["efo", "mondo"])) == "mondo"
    assert one(spark, ids.target_of(F.lit("EFO"), F.lit("HP_1"), ["efo", "mondo"])) == "efo"
    assert one(spark, ids.target_of(F.lit(None).cast("string"), F.lit("HP_1"), ["efo"])) is None


def test_comparison_forms(spark):
    assert list(one(spark, ids.comparison_forms(F.lit("EFO:1"), F.lit("http://x/EFO_1")))) == ["efo:1", "http://x/efo_1", "efo_1"]
    assert list(one(spark, ids.comparison_forms(F.lit(" "), F.lit("http://x/77")))) == ["http://x/77"]


def test_tiers(spark):
    assert one(spark, ev.tier_of(F.lit(None).cast("string"), F.lit("lexical"), F.lit(1.0))) == "LABEL_FULL"
    assert one(spark, ev.tier_of(F.lit("other"), F.lit("curated"), F.lit(0.5))) == "PARTIAL"
    assert one(spark, ev.tier_of(F.lit("other"), F.lit("else"), F.lit(1.0))) == "NONE"
    assert one(spark, ev.evidence_rank(F.lit("OLS_LEXICAL_FUZZY_LABEL"), F.lit("LABEL_FULL"))) == 3
    assert one(spark, ev.level(F.lit(0.1), F.lit("SYNONYM_FULL"))) == "HIGH"
    assert [one(spark, ev.xref_discount(F.lit(d))) for d in (0, 1, 2, 3)] == [0.75, 0.95, 0.85, 0.75]
