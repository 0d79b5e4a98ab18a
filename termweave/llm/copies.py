"""Problem 4: records that are the same but for white space, case, punctuation and the order of their fields.

Progressive partition refinement. Rows are classed by cheap invariants of the formatting first: the compared columns with the
stripped length, then the letter histogram. Each step is a combined count per class, and only rows of classes with several
members go on; the costly key (fields stripped, sorted and joined) is made for the last survivors only. Copies meet their
first record through a join that spreads a hot class over salts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.session import cut_lineage, table
from termweave.skew import join_on_skewed_key

#: Marks and white space, which count only directly between two ASCII digits.
_MARK = r"[\p{P}\p{Z}\s\x{85}\x1C-\x1F]"
_LOOSE = rf"{_MARK}(?![0-9])|(?<![0-9]){_MARK}"


def folded(value: Column) -> Column:
    """Case removed; upper first, so that letters with several lower-case forms agree; a sharp s is two."""
    return F.replace(F.lower(F.upper(value)), F.lit("ß"), F.lit("ss"))


def stripped(value: Column) -> Column:
    """Case, white space, marks and field limits removed; a mark or space directly between two digits stays, a semicolon never."""
    return F.regexp_replace(folded(value), rf";|{_LOOSE}", "")


def canonical(value: Column) -> Column:
    """The costly key: the stripped fields in sorted order. Empty fields are ignored."""
    fields = F.transform(F.split(folded(value), ";"), lambda f: F.regexp_replace(f, _LOOSE, ""))
    return F.array_join(F.array_sort(F.filter(fields, lambda f: f != "")), ";")


def histogram(text: Column) -> Column:
    """The letter histogram as one hash: that of the characters in sorted order."""
    return F.xxhash64(F.array_sort(F.split(text, "")))


def _rows(df: DataFrame, name: str, id_col: str, value: str, same: list[str]) -> DataFrame:
    """tbl, id, the value, one text for the columns that must be equal (null differing from every value)."""
    equal = F.concat_ws("\u0001", F.lit(name), *(F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in same))
    return df.filter(F.col(value).isNotNull()).select(F.lit(name).alias("tbl"), F.col(id_col).alias("id"), F.col(value).alias("v"), equal.alias("same"))


def _several(rows: DataFrame, key: str, total: int) -> DataFrame:
    """The rows whose class has several members; the counts are combined before the shuffle and a hot class is salted."""
    classes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_members")).filter("_members > 1")
    return join_on_skewed_key(rows, classes, key, "_members", "id", total).drop("_members")


def copy_classes(rows: DataFrame, total: int) -> DataFrame:
    """tbl, id, first id of the class, class size for every row of a class with several members.

    ``rows`` has tbl, id, v, same; ``total`` is the number of source rows. Two rows are copies when ``same`` is equal and the values
    have equal canonical forms. Rows with a null value are left out. Empty values and values made of marks alone
    form one class per ``same``. Ids are taken as unique inside a table. An empty table gives no rows.
    """
    # First invariants: the compared columns and the stripped length.
    rows = rows.withColumn("inv", F.xxhash64("same", F.length(stripped(F.col("v")))))
    rows = cut_lineage(_several(rows, "inv", total))
    # Second invariant, inside the classes left: the letter histogram.
    rows = rows.withColumn("inv", F.xxhash64("inv", histogram(stripped(F.col("v")))))
    rows = _several(rows, "inv", total)
    # The costly key holds everything compared, so that a collision of the cheap hashes cannot join two classes.
    full = F.unhex(F.sha2(F.concat_ws("\u0002", "same", canonical(F.col("v"))), 256))
    rows = cut_lineage(rows.select("tbl", "id", full.alias("key")))
    classes = rows.groupBy("key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")
    return join_on_skewed_key(rows, classes, "key", "n_copies", "id", total).drop("key")


SOURCES = (
    ("text_to_map", "row_id", "propertyValue", ["study", "bioentity", "propertyType"]),
    ("votes", "id", "property_value", ["bioentity", "property_type", "term_id", "vote"]),
)


def _all(spark, sf_dir: str) -> DataFrame:
    tables = [(table(spark, sf_dir, name), name, *rest) for name, *rest in SOURCES]
    rows = reduce(DataFrame.unionByName, (_rows(*t) for t in tables))
    return copy_classes(rows, sum(t[0].count() for t in tables))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).filter("id > keep_id").select("tbl", "keep_id", F.col("id").alias("copy_id"))


def p4_collapsed(spark, sf_dir: str) -> DataFrame:
    """One record of each class with several members, and its number of copies."""
    return _all(spark, sf_dir).filter("id = keep_id").select("tbl", "keep_id", "n_copies")


def _sql(name: str, id_col: str, value: str, same: list[str]) -> str:
    mark = r"[\p{P}\p{Z}\s\x{85}]"
    cols = ", ".join(same)
    return f"""
  SELECT '{name}' AS tbl, {id_col} AS id, min({id_col}) OVER w AS keep_id, count(*) OVER w AS n_copies
  FROM (SELECT {id_col}, {cols}, list_aggregate(list_sort(list_filter(list_transform(string_split(replace(lower(upper({value})), 'ß', 'ss'), ';'),
      lambda f: list_aggregate(list_filter(list_transform(range(1, length(f) + 1), lambda i:
        CASE WHEN NOT regexp_full_match(f[i], '{mark}') OR (regexp_full_match(f[i - 1], '[0-9]') AND i > 1 AND regexp_full_match(f[i + 1], '[0-9]'))
             THEN f[i] ELSE '' END), lambda c: c <> ''), 'string_agg', '')), lambda x: x <> '' AND x IS NOT NULL)), 'string_agg', ';') AS k
    FROM {name} WHERE {value} IS NOT NULL)
  WINDOW w AS (PARTITION BY {cols}, k)"""


_UNION = " UNION ALL ".join(_sql(*s) for s in SOURCES)
P4_SQL = f"SELECT tbl, keep_id, id AS copy_id FROM ({_UNION}) WHERE id > keep_id"
P4_COLLAPSED_SQL = f"SELECT tbl, keep_id, n_copies FROM ({_UNION}) WHERE id = keep_id AND n_copies > 1"
