"""Joins and rankings that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.session import cut_lineage

#: At most this many keys can be hot, as a hot key holds more than 1/HOT_KEYS of all rows.
HOT_KEYS = 2_000
#: Below this many rows a key is never worth splitting.
HOT_ROWS = 50_000


def join_on_skewed_key(rows: DataFrame, keyed: DataFrame, key: str, count: str, spread: str, total: int) -> DataFrame:
    """Inner join of many ``rows`` to a frame with one row per ``key`` and the number of rows the key has in ``count``.

    ``total`` is an upper bound of the number of rows, such as the row count of the source table. A key with more than max(HOT_ROWS, total / HOT_KEYS) rows is hot; there are at most HOT_KEYS such keys, which bounds
    the broadcast list of hot keys. Rows of hot keys are spread over salts by a hash of ``spread`` and their single
    counterpart is repeated once per salt; all other keys keep salt 0, so nothing is repeated for them.
    Null keys never match. An empty side gives an empty result.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    salts = F.ceil(F.col(count) / F.lit(limit)).cast("int")
    hot = keyed.filter(F.col(count) > limit).select(F.col(key).alias("_hot_key"), salts.alias("_salts"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1)))).cast("int")
    )
    copies = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > limit, salts - 1).otherwise(0))))
    return marked.drop("_hot_key", "_salts").join(copies, [key, "_salt"]).drop("_salt")


def slices_for(largest: int, rows: int = HOT_ROWS) -> int:
    """Slices that leave about so many rows of the largest group in each."""
    return max(1, -(-largest // rows))


def dense_positions(df: DataFrame, group: str, order: str, largest: int | None = None, out: str = "pos") -> DataFrame:
    """Number the rows of every group 0, 1, 2, ... without ever putting a whole group into one task.

    ``largest`` is the number of rows of the largest group, counted if not given; the rows of a group are cut by a hash of ``order`` into as many slices as keep
    a slice of that group near HOT_ROWS rows, numbered inside each slice, and shifted by the sizes of the slices before. ``order`` must be
    unique inside a group. The numbering is deterministic.
    """
    if largest is None:
        largest = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(order), F.lit(slices_for(largest))).cast("int"))
    sizes = cut.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_slice").orderBy(order)
    numbered = cut.withColumn("_rn", F.row_number().over(inside) - 1)
    return (
        numbered.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slice") == F.col("_s")))
        .withColumn(out, F.col("_before") + F.col("_rn"))
        .drop("_slice", "_rn", "_g", "_s", "_before")
    )


def ordered_positions(df: DataFrame, group: str, order: list[Column], out: str = "place") -> DataFrame:
    """Number all rows of every group 1, 2, 3, ... in the given order without ever putting a whole group into one task.

    The rows are cut into ranges of the group and the order, numbered inside each range, and shifted by what the group has in the ranges
    before. ``order`` must be unique inside a group; then only the cuts, not the numbers, depend on Spark's sample. A null group is a group of its own.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_lineage(df.repartitionByRange(ranges, F.col(group), *order).withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_range").orderBy(*order)
    numbered = cut.withColumn("_rn", F.row_number().over(inside))
    return (
        numbered.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
        .withColumn(out, F.col("_before") + F.col("_rn"))
        .drop("_range", "_rn", "_g", "_r", "_before")
    )
