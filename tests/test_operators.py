import gzip
import random

from pyspark.sql import functions as F

from termweave.functions.evidence import STEP
from termweave.operators import channels, obsolete, registry, segments, upkeep
from termweave.sources.files import Dialect, is_running_text, pasted, read_curated, read_delimited, sniff, split_line
from termweave.sinks import responses

TERMS = "iri string, label string, obsolete boolean, replaced_by string"


def chain(spark, *rows):
    return sorted((r.origin, r.iri, r.hops) for r in obsolete.resolve_chains(spark.createDataFrame(list(rows), TERMS)).collect())


def test_obsolete_chains(spark):
    live = ("z", "live", False, None)
    assert chain(spark, ("a", "x", True, "b"), ("b", "Obsolete y", None, "z"), live) == [("a", "z", 2), ("b", "z", 1)]
    assert chain(spark, ("a", "x", True, "b"), ("b", "y", True, "a"), live) == []
    assert chain(spark, ("a", "x", True, None), ("b", "x", True, "gone"), live) == []
    long = [(str(i), "x", True, str(i + 1)) for i in range(6)]
    assert chain(spark, *long, ("6", "end", False, None)) == [(str(i), "6", 6 - i) for i in range(1, 6)]
    assert chain(spark) == []


def test_registry(spark):
    reg = spark.createDataFrame([(1, "efo", "EFO", ["e-f"], "http://a.b/EFO_$1", "[0-9]{7}"), (2, "all", None, None, "http://a.b/$1", None), (3, "edam_data", "EDAM", None, "http://e/$1", None)], "ord int, prefix string, preferred_prefix string, synonyms array<string>, uri_format string, pattern string")
    got = registry.longest_prefix(spark.createDataFrame([("http://a.b/EFO_1",), ("http://a.b/X_1",), ("urn:x",), (None,)], "iri string"), "iri", reg)
    assert {r.iri: r.prefix for r in got.collect()} == {"http://a.b/EFO_1": "efo", "http://a.b/X_1": "all", "urn:x": None, None: None}
    ids = spark.createDataFrame([("EFO_0000001",), ("E.F:0000001",), ("EFO_12",), ("edam_data_7",), ("http://q",), ("nope_1",), (None,)], "s string")
    got = {r.s: r.iri for r in registry.expand(ids, "s", registry.registry_index(reg)).collect()}
    assert got == {"EFO_0000001": "http://a.b/EFO_0000001", "E.F:0000001": "http://a.b/EFO_0000001", "EFO_12": "EFO_12", "edam_data_7": "http://e/7", "http://q": "http://q", "nope_1": "nope_1", None: None}


def test_folds():
    assert segments.merge([(0, 5), (6, 9)], [(4, 7)]) == [(0, 5), (6, 9)]
    assert segments.merge([(0, 2), (3, 5)], [(0, 6), (5, 8)]) == [(0, 6)]
    assert segments.merge([], [(3, 4), (1, 2)]) == [(1, 2), (3, 4)]
    assert segments.greedy([(5, 6), (0, 3), (2, 9), (3, 5)]) == [(0, 3), (3, 5), (5, 6)]
    assert segments.paragraphs("a\n b\n \n\n c ") == [(0, 4), (9, 10)]
    text = "The red cells (of the liver), lung and a spleen."
    assert [text[a:b] for a, b in segments.segment(text)] == ["red cells", "liver", "lung", "spleen"]
    assert upkeep.chunks([1, 1, 100, 1], 2, 10) == [[0, 1], [2], [3]] and upkeep.chunks([]) == []


def test_merge_by_bisection_equals_the_scan():
    r = random.Random(2)
    for _ in range(200):
        cuts = sorted(r.sample(range(60), 12))
        parts = list(zip(cuts[::2], cuts[1::2]))
        tagged = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(8)})
        want = list(parts)
        for s, e in tagged:
            over = [m for m in want if m[0] < e and m[1] > s]
            if all(e - s > m[1] - m[0] for m in over):
                want = [m for m in want if m not in over] + [(s, e)]
        assert segments.merge(parts, tagged) == sorted(want)


def test_spans(spark):
    s = spark.createDataFrame([(1, 2, 5), (1, 4, 9), (1, 5, 6), (2, 0, 3)], "d long, start long, end long")
    assert sorted(map(tuple, segments.greedy_rows(s, "d").collect())) == [(1, 2, 5), (1, 5, 6), (2, 0, 3)]
    n = spark.createDataFrame([(1, 10), (2, 3), (3, 4)], "d long, n int")
    assert sorted(map(tuple, segments.gaps(segments.greedy_rows(s, "d"), n, "d").collect())) == [(1, 0, 2), (1, 6, 10), (3, 0, 4)]
    u = segments.unique_texts(spark.createDataFrame([(1, 0, 1, "A"), (1, 3, 4, "a"), (2, 0, 1, "a")], "d long, start long, end long, text string"), "d")
    assert sorted((r.d, r.text) for r in u.collect()) == [(1, "A"), (2, "a")]


def test_tagging(spark):
    entries = spark.createDataFrame([("lung node", "i1", "s", "Lung node", "o", "label", "o"), ("node", "i2", "s", "Node", "o", "synonym", "o"), ("ab", "i3", "s", "ab", "o", "label", "o")], "surface string, iri string, short_form string, label string, ontology string, string_type string, source string")
    texts = spark.createDataFrame([("Lung node",), ("left lung node",), ("ab",), ("",), ("é node",)], "text string")
    got = {(r.text, r.iri): (r.kind, round(r.confidence, 4)) for r in channels.tag_evidence(channels.tag_values(texts, entries)).collect()}
    assert got == {("Lung node", "i1"): ("OLS_TEXT_TAGGER", 1.0), ("left lung node", "i1"): ("OLS_TEXT_TAGGER_SUBSTRING", round(0.89 * 9 / 14, 4)), ("ab", "i3"): ("OLS_TEXT_TAGGER", 1.0)}
    docs = spark.createDataFrame([(1, "The lung-node, lung node."), (2, None)], "d long, text string")
    assert [(r.start, r.end, r.iri) for r in channels.tag_text(docs, "d", "text", entries).collect()] == [(15, 24, "i1")]


def test_expansions(spark):
    seeds = spark.createDataFrame([("p", 1, "a", 0.9, "OLS_TEXT_TAGGER"), ("p", 2, "a", 0.7, "OLS_TEXT_TAGGER"), ("p", 3, "a", 0.9, "OLS_EMBEDDING"), ("p", 4, "a", 0.9, None)], "prop_id string, seq long, iri string, confidence double, kind string")
    sim = spark.createDataFrame([("a", "b", 0.8), ("a", "a", 1.0), ("a", "c", 0.69)], "iri string, other string, similarity double")
    assert sorted((r.seq, r.other, round(r.confidence, 6)) for r in channels.expand_similar(seeds, sim).collect()) == [(1, "b", 0.504), (4, "b", 0.504)]
    x = spark.createDataFrame([("a", "t", 1), ("a", "u", 2), ("a", "w", 3)], "source_iri string, target_iri string, distance int")
    assert sorted((r.target_iri, round(r.confidence, 4)) for r in channels.expand_xrefs(seeds.filter("seq = 1"), x).collect()) == [("t", 0.855), ("u", 0.765)]


def test_upkeep(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y"), (None, 1, "z")], "k string, age int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 4, "late"), (None, 2, "w")], "k string, age int, v string")
    assert sorted((r.k or "", r.v) for r in upkeep.upsert(old, new, ["k"], "age").collect()) == [("", "w"), ("a", "new"), ("b", "y")]
    assert upkeep.evict(old, new.filter("k is null"), ["k"]).count() == 2
    assert upkeep.insert_absent(old, spark.createDataFrame([("a", 9, "q"), ("c", 9, "q"), (None, 9, "q")], old.schema), "k").count() == 4
    ev = spark.range(100).select("id", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=(F.col("id") / 10).cast("int"))).alias("ts"))
    kept = upkeep.newest_within(ev, "ts", "id", F.lit(10), 500)
    assert sorted(r.id for r in kept.collect()) == list(range(55, 100))
    assert upkeep.newest_within(ev, "ts", "id", F.lit(10), 1000).count() == 100
    assert upkeep.seeded_sample(ev, "id", 7).count() == 7


def test_files(spark, tmp_path):
    assert sniff(["a;b", "'x;y';2"]) == Dialect(";", "'", True)
    assert sniff(["1,2", "3,4"]).header is False and sniff(["a"]) == Dialect(",", "", False)
    assert split_line(' "a ""b"", c" , d', ",", '"') == ['a "b", c', "d"]
    path = str(tmp_path / "c.tsv.gz")
    with gzip.open(path, "wt") as f:
        f.write("STUDY\tBIOENTITY\tPROPERTY_TYPE\tPROPERTY_VALUE\tSEMANTIC_TAG\tANNOTATOR\tANNOTATION_DATE\ns\tb\torganism\trat\tT_1\tme\tnow\n")
    assert read_curated(spark, path).select("text", "term_id").collect() == [("rat", "T_1")]
    assert read_delimited(spark, path).count() == 1
    lines = spark.createDataFrame([("rat\torganism",), ("  ",), ("mice",), (None,)], "value string")
    assert sorted((r.text, r.property_type) for r in pasted(lines).collect()) == [("mice", None), ("rat", "organism")]
    assert is_running_text(lines).first()[0] is False


def test_responses(spark):
    props = spark.createDataFrame([(1, "cell", "x"), (2, None, "y")], "prop_id long, property_type string, text string")
    res = spark.createDataFrame([(1, 2, "T_2", "i2", "l2", "o", 0.6, "OLS_TEXT_TAGGER_SUBSTRING", "lexical", "o"), (1, 1, "T_1", "i1", "l1", "o", 0.95, "OLS_TEXT_TAGGER", "lexical", "o")], "prop_id long, place int, term_id string, iri string, label string, ontology string, confidence double, kind string, method string, datasource string")
    res = res.withColumn("preferred", F.lit(None).cast("boolean")).withColumn("supporting", F.lit(None).cast(f"array<array<{STEP}>>"))
    diag = spark.createDataFrame([(2, 2, "late", None), (2, 1, "first", None), (2, 3, None, "truncated: time"), (2, 4, None, "truncated: time")], "prop_id long, seq int, error string, warning string")
    m = {r.prop_id: r for r in responses.mappings(props, res, diag).collect()}
    assert [c.termId for c in m[1].candidates] == ["T_1", "T_2"] and m[2].candidates == []
    assert m[2].error == "first" and list(m[2].warnings) == ["truncated: time"] and m[2].truncated
    flat = responses.flat(responses.mappings(props, res))
    assert sorted((r.prop_id, r.term_id, r.note) for r in flat.collect() if r.prop_id == 2) == [(2, None, responses.NOT_MAPPED)]
    lines = [r.line for r in responses.report_lines(flat, "now").orderBy("prop_id", "place").collect()]
    assert len(lines) == 9 and lines[7] == "cell\tx\tl1\tHigh\tT_1\to\to\t" + responses.NO_STUDY
    body = responses.annotation_json(res.join(props, "prop_id").withColumn("study", F.lit("S")).withColumn("bioentity", F.lit("B")), "http://e", "http://l?iri=", 5).first().body
    assert '"confidence":"' in body and "http://e/o/" in body
