import random
import re

from pyspark.sql import functions as F

from termweave.llm.copies import _rows, copy_classes


def key(v):
    keep = []
    for f in v.upper().lower().split(";"):
        out = "".join(c for i, c in enumerate(f) if not re.match(r"[\s!-#%-*,-/:;?@\[-\]_{}“”’]", c) or (0 < i < len(f) - 1 and f[i - 1] in "0123456789" and f[i + 1] in "0123456789"))
        if out:
            keep.append(out)
    return ";".join(sorted(keep))


def run(spark, rows):
    df = spark.createDataFrame(rows, "id long, a string, b string, v string, same string, key string, inv long")
    return sorted((r.keep_id, r.id) for r in copy_classes(_rows(df, "t", "id", "v", ["a", "b"]), df.count()).collect() if r.id > r.keep_id)


def test_cases(spark):
    vs = ["dose: 5 mM; site: A", "SITE A;dose 5mm ;", "dose: 5 mM; site: B", "1,200", "1200", "1 200", " 1,200.", "straße", "STRASSE", "café", "cafe", "", "--", None, None, "x; x", "x", "Σας", "ΣΑΣ"]
    got = run(spark, [(i, "s", None, v, "", "", 0) for i, v in enumerate(vs)])
    assert got == [(0, 1), (3, 6), (7, 8), (11, 12), (17, 18)]


def test_null_equals_null_and_columns_count(spark):
    got = run(spark, [(1, None, "x", "v", "", "", 0), (2, None, "x", "V", "", "", 0), (3, "n", "x", "v", "", "", 0), (4, "", "x", "v", "", "", 0), (5, None, None, "v", "", "", 0)])
    assert got == [(1, 2)]
    assert run(spark, [(1, "a", "b", "v", "", "", 0)]) == []


def test_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", None]), "b", ";".join("".join(r.choice("aB1 2,.-") for _ in range(r.randint(0, 4))) for _ in range(r.randint(1, 3))), "", "", 0) for i in range(1500)]
    first, want = {}, []
    for i, a, b, v, *_ in rows:
        k = (a, b, key(v))
        if k in first:
            want.append((first[k], i))
        first.setdefault(k, i)
    assert run(spark, rows) == sorted(want)


def test_hot_class(spark, monkeypatch):
    import termweave.skew as skew

    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    df = spark.range(2000).select("id", F.lit("a").alias("a"), F.lit("b").alias("b"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    out = copy_classes(_rows(df, "t", "id", "v", ["a", "b"]), 2000)
    assert out.count() == 667 and out.select("keep_id", "n_copies").distinct().collect() == [(0, 667)]


def test_empty(spark):
    assert run(spark, []) == []
