from pyspark.sql import functions as F

from termweave.llm.topn import top_n_per_group


def test_ties_nulls_and_hot_group(spark):
    nan = float("nan")
    rows = [("g", 1, "b", 0.5), ("g", 2, "a", 0.5), ("g", 3, None, 0.5), ("g", 4, "a", 0.5), ("g", 5, "é", 0.5), ("g", 6, "z", None), ("g", 7, "z", nan), (None, 8, "z", 0.1), ("h", 9, "", -0.0), ("h", 10, "", 0.0), ("g", 1, "b", 0.5)]
    df = spark.createDataFrame(rows, "k string, id long, label string, score double").withColumn("rank", F.lit("clash"))
    ties = [F.col("label").asc_nulls_last(), F.col("id").asc()]
    got = {(r.k, r["rank"]): r.id for r in top_n_per_group(df, ["k"], "score", ties, 4).collect()}
    assert got == {("g", 1): 2, ("g", 2): 4, ("g", 3): 1, ("g", 4): 1, (None, 1): 8, ("h", 1): 9, ("h", 2): 10}
    assert top_n_per_group(df.limit(0), ["k"], "score", ties, 4).count() == 0


def test_plan_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id", F.rand(1).alias("score"))
    plan = top_n_per_group(df, ["k"], "score", [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
