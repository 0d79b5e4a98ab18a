"""Keeping stored tables: latest-wins upserts, insert-if-absent, eviction by key, age and size, job state, chunking, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.session import cut_lineage


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], age: str) -> DataFrame:
    """Both tables' rows, the newest of each key by ``age`` (nulls oldest); a new row wins ties. Null keys equal each other."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = F.struct(*(c for c in both.columns))
    best = both.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.max_by(rest, F.struct(F.col(age), "_new")).alias("r"))
    return best.select("r.*").drop("_new")


def insert_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows and the new rows whose key is not stored; the first of repeated new keys is any. Null keys are left out of the new rows."""
    fresh = new.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(stored.select(key), key, "left_anti")
    return stored.unionByName(fresh)


def evict(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows without those that the keys name; null equals null."""
    on = None
    g = gone.select(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys))).distinct()
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_g{i}"))
        on = c if on is None else on & c
    return stored.join(g, on, "left_anti")


def fresh(age: Column, now: Column, days: int) -> Column:
    """Not older than so many days; 0 days means no limit; a null age is not fresh under a limit."""
    return F.lit(True) if days == 0 else F.coalesce(age >= now - F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(False))


def newest_within(df: DataFrame, age: str, tie: str, size: Column, cap: int, keep: float = 0.9) -> DataFrame:
    """If all sizes together exceed ``cap``, the newest rows whose sizes sum to at most ``keep`` * cap; else all rows.

    The rows are cut into ranges of age and tie, newest first; a running sum inside each range is shifted by what the ranges before it hold, a table of
    one row per range. So no task sees all rows, nor all rows of a busy hour or of a null age. ``tie`` is unique and orders
    rows of one age. Null ages are oldest; null sizes count 0.
    """
    order = [F.col(age).desc_nulls_last(), F.col(tie).desc()]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_s", F.coalesce(size, F.lit(0)).cast("long")).repartitionByRange(ranges, *order).withColumn("_r", F.spark_partition_id())
    rows = cut_lineage(rows)
    sums = {r["_r"]: r["n"] for r in rows.groupBy("_r").agg(F.sum("_s").alias("n")).collect()}  # one row per range
    if sum(sums.values()) <= cap:
        return rows.drop("_s", "_r")
    before, so_far = [], 0
    for r in sorted(sums):
        before.append((r, so_far))
        so_far += sums[r]
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_r int, _before long"))
    inside = Window.partitionBy("_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("_run", F.sum("_s").over(inside)).join(offsets, "_r")
    return run.filter(F.col("_before") + F.col("_run") <= F.lit(keep * cap)).drop("_s", "_r", "_run", "_before")


def maintain(df: DataFrame, age: str, tie: str, size: Column, days: int, cap: int) -> DataFrame:
    """One round of upkeep: rows older than so many days before the newest go, then what exceeds the cap."""
    now = F.broadcast(df.agg(F.max(age).alias("_now")))  # one row
    return newest_within(df.crossJoin(now).filter(fresh(F.col(age), F.col("_now"), days)).drop("_now"), age, tie, size, cap)


def chunks(sizes: list[int], most_items: int = 500, most_size: int = 64 * 1024) -> list[list[int]]:
    """Places of items in greedy chunks, in order: at most so many items and bytes (each with one separator) a chunk; an item over the size is alone."""
    out: list[list[int]] = []
    total = 0
    for i, n in enumerate(sizes):
        if not out or len(out[-1]) >= most_items or total + n + 1 > most_size:
            out.append([])
            total = 0
        out[-1].append(i)
        total += n + 1
    return out


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the same on every run: the smallest by a hash of key and seed."""
    return df.withColumn("_o", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))).orderBy("_o").limit(n).drop("_o")


def evictable(done_at: Column, started_at: Column, collected: Column, now: Column) -> Column:
    """A job that was collected, ended 30 minutes ago, or has run for 6 hours."""
    return F.coalesce(collected, F.lit(False)) | F.coalesce(done_at < now - F.expr("INTERVAL 30 MINUTES"), F.lit(False)) | (done_at.isNull() & F.coalesce(started_at < now - F.expr("INTERVAL 6 HOURS"), F.lit(False)))
