"""Problem 7: the N highest-scoring items of every group, with one consistent tie rule.

A row_number window ordered by score, tie columns and identifier, with a filter on the rank. The optimiser turns the filter into
a group limit that runs before and after the shuffle, so that a task sends at most N rows of any group, however large
the group is, and no group is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.session import table


def top_n_per_group(df: DataFrame, group: list[str], score: str, ties: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group by ``score`` descending, then by ``ties``; ``rank`` counts from 1.

    Rows with a null or NaN score are not ranked and left out. A null group is a group of its own. Repeated rows each count.
    If ``ties`` does not end in a unique column, equal rows are interchangeable. An empty table gives no rows. Other columns pass through; a column already named ``rank`` is replaced.
    """
    ranked = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), *ties)
    return ranked.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def candidates_top(spark, sf_dir: str, n: int = 5) -> DataFrame:
    c = table(spark, sf_dir, "candidates").select("query_key", "cand_id", "label", "confidence")
    return top_n_per_group(c, ["query_key"], "confidence", [F.col("label").asc_nulls_last(), F.col("cand_id").asc()], n)


def p7_found(spark, sf_dir: str) -> DataFrame:
    return candidates_top(spark, sf_dir).select("query_key", "cand_id")


P7_SQL = """
SELECT query_key, cand_id FROM (
  SELECT query_key, cand_id, row_number() OVER (PARTITION BY query_key
    ORDER BY confidence DESC, label ASC NULLS LAST, cand_id) AS rn
  FROM candidates WHERE confidence IS NOT NULL AND NOT isnan(confidence))
WHERE rn <= 5
"""
