"""What the mapper leaves on disk: no shuffle files behind a checkpoint, one move of the rows by property, chains only of what is left."""

import random
import time

from conftest import rows
from pyspark.sql import functions as F

from termweave.functions import evidence as ev
from termweave.operators import channels, rules
from termweave.plans import service
from termweave.plans.filters import Filter
from termweave.session import cut_lineage
from test_service import PROPS, vocabulary  # noqa: F401


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))

    before = shuffles()
    out = cut_lineage(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(20):
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before
    assert out.count() == 7


def test_windows_reduce_as_joins_do(spark):
    r = random.Random(3)
    kinds = [*ev.KINDS, None]
    made = [
        (p, f"{i:05d}", r.choice(["i1", "i2", "i3", None]), r.choice(["DIZO_1", "PHEXO_2", None]), "l", r.choice(["dizo", "phexo", "x"]), r.choice(kinds), r.choice([0.3, 0.5, 0.7, 0.89, 0.9, 1.0]), "d", r.choice(["disease", "organ", None]), None)
        for p in range(60)
        for i in range(r.randint(1, 12))
    ]
    e = spark.createDataFrame(made, f"prop_id long, seq string, iri string, term_id string, label string, ontology string, kind string, confidence double, datasource string, property_type string, chain array<{ev.STEP}>")
    e = e.withColumn("chain", F.col("seq"))
    f, priors = Filter(targets=("dizo", "phexo")), [("disease", ["dizo"], [])]
    for how in (rules.reduce_full, rules.reduce_light):
        far = how(e, f, ["PHEXO_2"], priors)
        near = how(e, f, ["PHEXO_2"], priors, near=True).select(*far.columns)
        assert rows(far) == rows(near) and rows(near)


def test_rows_move_once_by_property(spark, vocabulary):  # noqa: F811
    props = cut_lineage(spark.createDataFrame([(1, None, "melanomma"), (2, None, "rat")], PROPS))
    found = service.map_properties(props, vocabulary, chains=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(prop_id") <= 1
    assert all(r.chain is None for r in found.collect())


def test_chains_are_those_of_the_evidence(spark, vocabulary):  # noqa: F811
    texts = ["a blue rat", "obsolete old thing", "melanomma", "rats strain", "Cardiac Infarct"]
    props = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], PROPS)
    told = {(r.text, r.seq): r.chain for r in service.evidence_of(props, vocabulary, return_all=True).collect()}
    found = service.map_properties(props, vocabulary, return_all=True).collect()
    assert found and all(r.chain == told[r.text, r.seq] for r in found)
    supported = [r for r in found if r.supporting]
    assert supported and all(c in [told[k] for k in told if k[0] == r.text] for r in supported for c in r.supporting)


def test_no_pair_of_sets_comes_twice(spark):
    sets = spark.createDataFrame([("x", ["a", "b", "c"]), ("y", ["a", "b", "c", "d"])], "l string, g array<string>")
    found = channels.set_join(sets, sets.withColumnRenamed("l", "r"), 0.5)
    assert rows(found.select("l", "r", F.round("jaccard", 6))) == [("x", "x", "1.0"), ("x", "y", "0.75"), ("y", "x", "0.75"), ("y", "y", "1.0")]


def test_chains_take_no_look_up(spark, vocabulary):  # noqa: F811
    props = cut_lineage(spark.createDataFrame([(1, None, "melanomma"), (2, None, "obsolete old thing")], PROPS))
    found = service.map_properties(props, vocabulary)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(prop_id") == 1 and "hashpartitioning(text" not in plan.split("Exchange hashpartitioning(prop_id")[0]
    assert {r.text: [s.matchType for s in r.chain] for r in found.collect()}["obsolete old thing"] == ["OLS_TEXT_TAGGER", "OBSOLETE_REPLACEMENT"]


def test_slices_give_the_rows_of_the_whole(spark):
    props = spark.createDataFrame([(i, None if i % 2 else "t", f"x{i // 2}") for i in range(40)], PROPS)
    seen = []

    def of(part):
        got = part.collect()
        seen.append({r.text for r in got})
        assert all(sum(r.text == t for r in got) == 2 for t in seen[-1])
        return part.select("prop_id", "text")

    assert rows(service.by_slices(props, of, 10)) == rows(props.select("prop_id", "text"))
    assert len(seen) == 4 and sum(map(len, seen)) == 20
    seen.clear()
    assert service.by_slices(props.limit(0), of, 10).count() == 0 and len(seen) == 1
