"""Every core query against its SQL twin on the smallest data, and the stream."""

import pytest
from conftest import rows

import __spark_entry__ as entry
from termweave.plans import queries as core
from termweave.streaming.mapping import distinct_stream, label_stream, map_stream


@pytest.mark.parametrize("name", sorted(set(core.SQL)))
def test_twin(spark, duck, small, name):
    df = core.QUERIES[name](spark, small)
    out = duck.execute(core.SQL[name])
    names = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.select(*names)) == sorted(tuple(map(str, r)) for r in out.fetchall())


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and core.FLAGSHIP in core.QUERIES


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_service(spark, small):
    out = core.QUERIES["service_map"](spark, small)
    firsts = out.filter("place = 1")
    assert firsts.count() == out.select("prop_id").distinct().count() > 0


def test_stream(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    spark.createDataFrame([("rat", "organism"), ("rat", "organism"), ("RAT", None), ("none", None)], "text string, property_type string").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS at").write.parquet(src)
    props = distinct_stream(spark.readStream.schema("text string, property_type string, at timestamp").parquet(src), "at", "1 hour")
    terms = spark.createDataFrame([("i1", "Rat")], "iri string, label string")
    query = map_stream(props, lambda b: (label_stream(b, terms), b.join(terms, b.text == terms.label, "left_anti")), lambda rest: rest.select("text"), lambda df, step: seen.append((step, df.count())), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert seen == [("shallow", 2), ("deep", 3)]
