import unicodedata

import pytest

from pyspark.sql import functions as F

from termweave.llm import lookalike
from termweave.llm.lookalike import ALIKE, Reader, count_bigrams, look, look_alike_pairs

SAME = [
    ("sodium trace", "ѕоdium tra­сe"),
    ("acid", "ａｃｉｄ"),
    ("café", "café"),
    ("flow fix", "ﬂow ﬁx"),
    ("type II", "type Ⅱ"),
    ("a-b", "a‑b"),
    ("a b", "a　b‍"),
    ("α-x", "⍺-x"),
    ("cat", "ϲat"),
    ("ë", "ё"),
]
OTHER = [("a", "A"), ("a b", "a  b"), ("cafe", "café"), ("type 1", "type ₁"), ("x2", "x²"), ("a", "α"), ("l", "1"), ("b", "β"), ("a\tb", "a b")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(a, b):
    assert look(a) == look(b) and look(b) == look(unicodedata.normalize("NFD", b))


@pytest.mark.parametrize("a, b", OTHER)
def test_other_look(a, b):
    assert look(a) != look(b)


def test_no_letter_is_in_two_classes():
    members = [c for k, v in ALIKE.items() for c in (k, *v)]
    assert len(members) == len(set(members))


def test_readings_keep_to_a_script():
    r = Reader(count_bigrams(["hot soda acid", "стелонит морвит соль", "сорт опора"]))
    assert r.read("сорa hоt") in ("copa hot", "сора hot")
    assert r.read("cоль") == "соль"
    assert r.read("hоt") == "hot"
    assert r.read(None) is None and r.read("") == ""


def test_pairs(spark):
    rows = spark.createDataFrame([(1, "hоt", "x"), (2, "hot", "x"), (3, None, "x"), (4, "", "x"), (5, "hоt", "x"), (6, "hot ", "x"), (7, "ᴢ" * 20000, "x")], "row_id long, v string, iri string")
    terms = spark.createDataFrame([("t1", "hot", 1), ("t2", "hot", 1), ("t3", None, 1), ("t4", "h​ot", 1), ("t5", "", 1)], "iri string, label string, row_id long")
    got = sorted(map(tuple, look_alike_pairs(rows, "row_id", "v", terms, "iri", "label").collect()))
    assert got == [(1, "t1"), (1, "t2"), (1, "t4"), (2, "t4"), (5, "t1"), (5, "t2"), (5, "t4")]
    assert look_alike_pairs(rows.limit(0), "row_id", "v", terms, "iri", "label").count() == 0
    assert look_alike_pairs(rows, "row_id", "v", terms.limit(0), "iri", "label").count() == 0


def test_reader_follows_the_counts(spark):
    """Two vocabularies in one session: each column reads under its own counts."""
    df = spark.createDataFrame([("сор",)], "t string")
    latin, cyrillic = ({("^", x): 50 for x in ("c", "с")} | pairs for pairs in ({("c", "o"): 90, ("o", "p"): 90, ("p", "$"): 90}, {("с", "о"): 90, ("о", "р"): 90, ("р", "$"): 90}))
    got = [df.select(lookalike.one_form(F.col("t"), b).alias("f")).first().f for b in (latin, cyrillic, latin)]
    assert got == ["cop", "сор", "cop"]
