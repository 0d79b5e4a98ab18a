import json
import random

from termweave.operators.nested import ANNOTATION, RESPONSE, broken_bodies, flatten


def elements(x):
    return [] if x is None else [(i, e) for i, e in enumerate(x if isinstance(x, list) else [x]) if e is not None]


def get(o, k):
    return o.get(k) if isinstance(o, dict) else None


def text(x):
    return x if isinstance(x, str) else "" if x is None else json.dumps(x)


def brute(i, j):
    for m, M in elements(get(j, "mappings")):
        for c, C in elements(get(M, "candidates")):
            yield ("candidate", i, f"{m}.{c}", f"{m}", text(get(C, "label")))
            for s, S in elements(get(C, "mappingProvenance")):
                yield ("step", i, f"{m}.{c}.{s}", f"{m}.{c}", text(get(S, "method")))
            for a, A in elements(get(C, "supportingProvenance")):
                for s, S in elements(A):
                    yield ("support", i, f"{m}.{c}.{a}.{s}", f"{m}.{c}.{a}", text(get(S, "method")))


def random_body(r):
    words = ["a", 'q"uote', "back\\slash", "{[,:]}", "é ", "", "\\", '\\"', "tab\t"]
    step = lambda: r.choice([None, {"method": r.choice(words), "x": [1, {"y": "]"}]}, {"method": None}, {}])
    many = lambda f: r.choice([None, [], f(), [f() for _ in range(r.randint(1, 3))]])
    cand = lambda: r.choice([None, {"label": r.choice(words), "mappingProvenance": many(step), "supportingProvenance": r.choice([None, [], [[step(), step()], [], [step()]]])}, {"extra": [[[]]], "label": 3}])
    return {"z": r.choice(words), "mappings": many(lambda: r.choice([None, {"candidates": many(cand), "t": r.choice(words)}]))}


def rows(df):
    return sorted(tuple(x) for x in df.select("kind", "rec_id", "node", "parent", "val").collect())


def test_against_parsing(spark):
    r = random.Random(5)
    docs = [(i, random_body(r)) for i in range(300)]
    bodies = [(i, json.dumps(d, ensure_ascii=bool(i % 2), indent=[None, 1, 2][i % 3]), "extra", "clash") for i, d in docs]
    df = spark.createDataFrame(bodies, "response_id long, body string, node string, rec_id string")
    assert rows(flatten(df, "response_id", "body", RESPONSE)) == sorted(x for i, d in docs for x in brute(i, d))


def test_defined_cases(spark):
    deep = {"derivedFrom": {"derivedFrom": {"provenance": {"evidence": "B"}}, "provenance": None}}
    bodies = [(1, None), (2, ""), (3, "  "), (4, "12"), (5, '{"derivedFrom": "x'), (6, json.dumps(deep)), (None, '{"derivedFrom":{"provenance":{"evidence":"N"}}}'), (7, '{"derived\\u0046rom":{"provenance":{"evidence":"\\u00e9"}}}'), (8, '{"derivedFrom":{"provenance":{"evidence":"x"}},"derivedFrom":{"provenance":{"evidence":"last"}}}'), (9, "]["), (11, '{"derivedFrom":{"a":[}}}'), (10, '{"derivedFrom":{}}'), (10, '{"derivedFrom":{}}')]
    df = spark.createDataFrame(bodies, "id long, body string")
    got = [(r.rec_id, r.node, r.val) for r in flatten(df, "id", "body", ANNOTATION).collect()]
    want = [(6, "1", ""), (6, "2", "B"), (None, "1", "N"), (7, "1", "é"), (8, "1", "last"), (10, "1", ""), (10, "1", "")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(r[0] for r in broken_bodies(df, "id", "body").collect()) == [2, 3, 5, 9, 11]
    assert flatten(df.limit(0), "id", "body", ANNOTATION).count() == 0


def test_very_wide(spark):
    body = json.dumps({"mappings": [{"candidates": [{"label": "x" * 50} for _ in range(60_000)]}]})
    df = spark.createDataFrame([(1, body)], "id long, body string")
    assert flatten(df, "id", "body", RESPONSE).count() == 60_000
