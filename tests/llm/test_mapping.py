import random

from termweave.llm.mapping import DOMAIN, distance, map_values, slip_join, slips

TERMS = [
    ("i1", "acute lorlunosis", '["DZS2"]'), ("i2", "chronic lorlunosis", "[]"), ("i3", "left ventaphoskar node", None), ("i4", "sodium thyrbrirazide", '"Viocalv salt"'),
    ("i5", "stinaltisitis type 2", "bad json"), ("i6", "stinaltisitis type 1", None), ("i7", "β-sidiskmyxamide", None), ("i8", "Byflophó disease", None), ("i9", "shared name body", None), ("i10", "shared name body", None), ("i11", None, None),
]
CASES = [
    ("Acute lorlunosis", "i1"), ("lorlunosis, acute (NOS)", "i1"), ("acute lorlnuosis etc", "i1"), ("dzs2", "i1"), ("DZS3", ""), ("vіocalv  salt?", "i4"), ("thyrbrirazidesodium", "i4"),
    ("STINALTISITIS TYPE II", "i5"), ("stinaltisitis (1)", "i6"), ("stinaltisitis type 3", ""), ("B-sidiskmyxamide", "i7"), ("beta sidiskmyxamide", "i7"), ("BYFLOPHO DISEASE", "i8"), ("prob. the left ventaphoskar node", "i3"),
    ("right ventaphoskar node", ""), ("shared name body", ""), ("tbd", ""), ("", ""), (None, ""), ("???", ""), ("x" * 5000, ""),
]


def test_cases(spark):
    values = spark.createDataFrame([(i, v, "clash", "clash", 0) for i, (v, _) in enumerate(CASES)], "row_id long, v string, iri string, words string, l int")
    terms = spark.createDataFrame([(*t, "x", 1) for t in TERMS], "iri string, label string, syn string, row_id string, r int")
    got = {r.row_id: r.iri for r in map_values(values, "row_id", "v", terms, "iri", "label", "syn").collect()}
    assert {CASES[i][0]: v for i, v in got.items()} == dict(CASES)
    assert map_values(values.limit(0), "row_id", "v", terms, "iri", "label", "syn").count() == 0
    assert {r.iri for r in map_values(values, "row_id", "v", terms.limit(0), "iri", "label", "syn").collect()} == {""}


def test_join_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
    left, right = {word() for _ in range(150)}, {w: min(r.randint(0, 2), (len(w) + 1) // 4) for w in (word() for _ in range(150))}
    got = {(x.l, x.r): x.slips for x in slip_join(spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame(list(right.items()), "r string, s int"), 2).collect()}
    assert got == {(a, b): slips(a, b, s) for a in left for b, s in right.items() if slips(a, b, s) <= s}
    assert len(got) > 20


def test_without_slips_only_equal_strings(spark):
    values = spark.createDataFrame([(0, "acute lorlunosis"), (1, "acute lorlunosos")], "row_id long, v string")
    terms = spark.createDataFrame(TERMS, "iri string, label string, syn string")
    assert {r.row_id: r.iri for r in map_values(values, "row_id", "v", terms, "iri", "label", "syn", by_length=()).collect()} == {0: "i1", 1: ""}


def test_slips():
    assert [slips(*x, 2) for x in (("abc", "abc"), ("abc", "acb"), ("abc", "abd"), ("abc", "ab"), ("abcd", "dcba"), ("", "ab"), ("a", "abcd"))] == [0, 1, 1, 1, 3, 2, 3]
    assert DOMAIN.comparable("Tumour of the Lung, AD") == "tumor of the lung autosomal dominant"
    assert distance("type 1 x", "type 2 x") is None
