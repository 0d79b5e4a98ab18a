"""map_values against brute force by its own rule, where slips leave few trigrams."""

import random

from termweave.llm.mapping import DOMAIN, allowed, distance, map_values


def slipped(r, s, n):
    for _ in range(n):
        i, x = r.randrange(len(s) - 1), r.choice("bcdfgklmnprst")
        s = r.choice((s[:i] + s[i + 1 :], s[:i] + x + s[i:], s[:i] + x + s[i + 1 :], s[:i] + s[i + 1] + s[i] + s[i + 2 :]))
    return s


def grams(s):
    return {s[i : i + 3] for i in range(len(s) - 2)} or {s}


def test_every_allowed_slip_is_found(spark):
    r = random.Random(11)
    names = ["asthma", "diabetes", "aaaaaaaaaaaaaaaa", "disease of the lung", "fox of it"]
    for n in range(6, 21):
        for _ in range(4):
            word = "".join(r.choice("abdegiklmnoprstu") for _ in range(n))
            names.append(word if r.random() < 0.5 else f"{word[: n // 2]} {word[n // 2 :]}")
    values = {"astkma", "diabtees", "diseas of thelung", "fox fo it", "fx of it"} | {slipped(r, name, 5) for name in names}
    for name in names:
        turned = " ".join(reversed(name.split())) if len(name.split()) == 2 else name
        for form in (name, turned):
            values |= {slipped(r, form, k) for k in range(1, allowed(len(DOMAIN.content(name))) + 1) for _ in range(6)}
    want = {}
    for v in values:
        near = []
        for i, name in enumerate(names):
            d = distance(DOMAIN.comparable(v), DOMAIN.comparable(name))
            a, b = grams(DOMAIN.content(DOMAIN.comparable(v))), grams(DOMAIN.content(DOMAIN.comparable(name)))
            if d is not None:
                near.append((d, -len(a & b) / len(a | b), f"i{i:03d}"))
        want[v] = min(near)[2] if near else ""
    rows = spark.createDataFrame([(v, v) for v in values], "id string, v string")
    terms = spark.createDataFrame([(f"i{i:03d}", name, None) for i, name in enumerate(names)], "iri string, label string, syn string")
    got = {x.id: x.iri for x in map_values(rows, "id", "v", terms, "iri", "label", "syn").collect()}
    assert want["astkma"] == "i000" and want["diabtees"] == "i001"
    assert {v: (got[v], w) for v, w in want.items() if got[v] != w} == {}
