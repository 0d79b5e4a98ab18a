import random

from pyspark.sql import functions as F

from termweave.plans import channel_queries, rule_queries
from termweave.skew import ordered_positions


def test_positions_of_a_hot_group(spark):
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.randint(0, 9), i) for i in range(3000)]
    out = ordered_positions(spark.createDataFrame(rows, "g string, score int, id long").repartition(5), "g", [F.col("score").desc(), F.col("id").asc()])
    got = {(x.g, x.place): x.id for x in out.collect()}
    want = {}
    for g in ("hot", "b", None):
        for n, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2])), 1):
            want[g, n] = x[2]
    assert got == want
    assert ordered_positions(spark.createDataFrame([], "g string, score int, id long"), "g", [F.col("id").asc()]).count() == 0


def test_vote_history_all_keeps_every_vote(spark, tmp_path):
    rows = [("hot", i, "up", f"2024-01-{1 + i % 9:02d}") for i in range(500)] + [("few", 900, "down", None), (None, 901, "up", "2024-01-01")]
    spark.createDataFrame(rows, "property_value string, id long, vote string, created_at string").write.parquet(f"{tmp_path}/votes.parquet")
    got = {(r.property_value, r.place): r.id for r in channel_queries.vote_history_all(spark, str(tmp_path)).collect()}
    want = {("hot", n): x[1] for n, x in enumerate(sorted(rows[:500], key=lambda x: (x[3], x[1]), reverse=True), 1)}
    assert got == want | {("few", 1): 900}


def test_rank_all_keeps_every_result(spark, small):
    ranked = rule_queries.rank_all(spark, small)
    assert ranked.count() == rule_queries.dedup_by_term(spark, small).count()
    worst = ranked.groupBy("prop_id").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"), F.count_distinct("place").alias("places")).filter("n <> last or n <> places")
    assert worst.count() == 0
