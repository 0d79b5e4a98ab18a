import random
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from termweave.llm.packing import best_filling, fill_containers, pack_lengths


def test_best_filling_is_the_best():
    r = random.Random(1)
    for _ in range(60):
        left = sorted(((n, r.randint(1, 3)) for n in r.sample(range(1, 30), 4)), reverse=True)
        room = r.randint(0, 60)
        sums = {sum(n * k for (n, _), k in zip(left, ks)) for ks in product(*(range(c + 1) for _, c in left))}
        got = best_filling(room, left)
        assert sum(n * k for n, k in got) == max(s for s in sums if s <= room)
        assert all(k <= dict(left)[n] for n, k in got)


def test_counts_are_used_up():
    r = random.Random(2)
    counts = {r.randint(1, 100): r.randint(1, 500) for _ in range(40)}
    used = Counter()
    for f in pack_lengths(counts, 100):
        assert sum(n * k for n, k in f.parts) <= 100
        for n, k in f.parts:
            used[n] += k * f.times
    assert used == counts
    assert pack_lengths({}) == []


def test_containers(spark):
    r = random.Random(3)
    sizes = [(i, r.choice([None, 0, 5, 5, 7, 30, 64, 100, 250, 999])) for i in range(3000)]
    df = spark.createDataFrame(sizes, "doc_id long, size long").withColumn("piece", F.lit("clash")).withColumn("n", F.lit(1))
    got = fill_containers(df, "doc_id", "size", 100).collect()
    used, parts = Counter(), {}
    for x in got:
        used[x.container_id] += x.n
        parts.setdefault(x.doc_id, []).append((x.piece, x.start, x.n))
    assert max(used.values()) <= 100 and sorted(used) == list(range(len(used)))
    want = {i: [(k, s, min(100, n - s)) for k, s in enumerate(range(0, n, 100))] for i, n in sizes if n}
    assert {k: sorted(v) for k, v in parts.items()} == want
    assert len(used) <= 1.01 * sum(n or 0 for _, n in sizes) / 100 + 1
    assert fill_containers(df.limit(0), "doc_id", "size", 100).count() == 0
