import time

import pytest
from pyspark.sql import functions as F

from termweave.operators import client
from termweave.session import BROADCAST_ROWS, cut_lineage, ensure_checkpoint_dir, is_small
from termweave.sources.files import load_config
from termweave.skew import dense_positions, slices_for
from termweave.streaming.control import within


def test_budget(spark):
    slow = lambda: spark.range(8, numPartitions=4).mapInArrow(lambda bs: [(time.sleep(20), b)[1] for b in bs], "id long").count()
    began = time.time()
    got, warning = within(spark, 1.0, slow, -1)
    assert got == -1 and warning.startswith("Time budget of 1000 ms") and time.time() - began < 15
    assert within(spark, 60, lambda: spark.range(5).count(), -1) == (5, None)
    with pytest.raises(ZeroDivisionError):
        within(spark, 60, lambda: 1 / 0, -1)


def test_sizes(spark):
    small = cut_lineage(spark.range(10).withColumn("s", F.lit("x" * 100)))
    assert is_small(small) and not is_small(small, 9) and not is_small(small, max_bytes=500)
    assert not is_small(spark.range(10), 9) and is_small(spark.range(0)) and BROADCAST_ROWS
    assert ensure_checkpoint_dir(spark)


def test_a_cluster_needs_a_shared_folder():
    class Sc:
        master = "spark://host:1"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("N", (), {"isDefined": staticmethod(lambda: False)})())})()

    class Session:
        sparkContext = Sc()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_slices(spark):
    assert slices_for(0) == 1 and slices_for(50_001) == 2 and slices_for(10**9) == 20_000
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    got = [r.pos for r in dense_positions(df, "g", "id", 200_000).filter("g = 1").collect()]
    assert sorted(got) == list(range(333))


def test_describe_and_config(tmp_path):
    assert client.describe(None) == "unknown error" and client.describe(ValueError()) == "ValueError" and client.describe(KeyError("x")) == "KeyError: 'x'"
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert load_config(str(tmp_path / "c.json")) == {"a": 1}
    (tmp_path / "d.json").write_text("{")
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "d.json"))


def test_semantic_tag_and_events(spark, tmp_path):
    from termweave.functions.evidence import STEP
    from termweave.sinks import responses

    df = spark.createDataFrame([(["a", " ", None], "T"), ([], "T")], "t array<string>, term string")
    steps = F.transform("t", lambda x: F.struct(x.alias("target")))
    assert [r[0] for r in df.select(responses.semantic_tag(steps, F.col("term"))).collect()] == ["a", "T"]
    rows = responses.event_rows(spark.createDataFrame([(5,), (3,)], "ord long"), "ord").collect()
    assert sorted((r.completed, r.type, r.ord, r.total) for r in rows) == [(1, "result", 3, 2), (2, "done", None, 2), (2, "result", 5, 2)]
    assert STEP
